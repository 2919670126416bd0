from qalytics.sources.fixtures import Bronze  # noqa: F401
