from qalytics.plans.relations import Relations  # noqa: F401
