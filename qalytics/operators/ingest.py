"""Ingest (§2.A) as Spark jobs over landed records.

The reference pulls records from HTTP APIs and appends them to append-only
bronze tables with an audit stamp, keeping a high-water mark per project.
Here the landed records are DataFrames (JSON / parquet files in practice);
each step is a DataFrame operator, and the stateful parts (watermarks, the
sync-state upsert) are relational: join, aggregate, anti-join + union."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qalytics import config as C
from qalytics import schemas as S
from qalytics.functions import ts_lit


# ------------------------------------------------------------ record shaping
def epoch_normalize(df: DataFrame, columns: tuple[str, ...] = S.EPOCH_COLUMNS) -> DataFrame:
    """Epoch seconds in the known timestamp columns become UTC timestamps;
    text is parsed leniently; values already typed as timestamps pass."""
    out = {}
    types = dict(df.dtypes)
    for c in columns:
        if c not in types:
            continue
        t = types[c]
        if t in ("bigint", "int", "smallint", "tinyint"):
            out[c] = F.timestamp_seconds(F.col(c)).cast("timestamp_ntz")
        elif t in ("double", "float") or t.startswith("decimal"):
            out[c] = F.when(F.col(c) == F.floor(F.col(c)), F.timestamp_seconds(F.col(c).cast("long")).cast("timestamp_ntz"))
        elif t == "string":
            out[c] = F.coalesce(F.timestamp_seconds(F.col(c).try_cast("long")).cast("timestamp_ntz"),
                                F.try_to_timestamp(F.col(c)).cast("timestamp_ntz"))
        elif t == "timestamp":
            out[c] = F.col(c).cast("timestamp_ntz")
    return df.withColumns(out) if out else df


def json_stringify(df: DataFrame, columns: tuple[str, ...] = ("custom_status_count", "entries")) -> DataFrame:
    """Struct / array / map columns among ``columns`` become JSON text."""
    out = {c: F.to_json(F.col(c)) for c, t in df.dtypes
           if c in columns and (t.startswith("struct") or t.startswith("array") or t.startswith("map"))}
    return df.withColumns(out) if out else df


def collect_custom_fields(records: DataFrame, text_col: str = "record", out_col: str = "custom_fields") -> DataFrame:
    """Every ``custom_*`` key of a landed JSON record, gathered into one JSON
    object column (NULL when the record has none). Values keep their JSON
    type (booleans, numbers, nested objects)."""
    m = F.from_json(F.col(text_col), "map<string,variant>")
    custom = F.map_filter(m, lambda k, v: k.startswith(C.CUSTOM_FIELD_PREFIX))
    return records.withColumn(out_col, F.when(F.size(custom) > 0, F.to_json(custom)))


def project_to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Keep the declared columns in declared order (unknown fields are
    dropped, missing ones are NULL), cast to the declared types."""
    have = set(df.columns)
    cols = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    return df.select(*cols)


def bronze_append(df: DataFrame, entity: str, as_of: _dt.datetime, source: str = C.SOURCE_TAG) -> DataFrame:
    """Records of ``entity`` shaped for its bronze table: epoch times
    normalised, JSON columns stringified, audit stamp added, projected onto
    the declared schema. An empty input gives an empty frame (a no-op
    append)."""
    schema = S.BRONZE[entity]
    staged = json_stringify(epoch_normalize(df)).withColumns({"_extracted_at": ts_lit(as_of), "_source": F.lit(source)})
    return project_to_schema(staged, schema)


def write_bronze(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Append to a bronze table (a plain parquet directory)."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


# ------------------------------------------------------------ nested sources
def _declared(node: Column, schema: T.StructType, leave: tuple[str, ...] = ()) -> list[Column]:
    """The declared columns of a parsed record. Times stay text (epoch seconds
    or a timestamp, for ``epoch_normalize``); a column declared as text that
    holds an object or a list becomes its JSON text; a value of another type
    than declared is NULL. Unknown keys are dropped."""
    out = []
    for f in schema.fields:
        if f.name in leave:
            continue
        path = f"$.{f.name}"
        if f.name in S.EPOCH_COLUMNS:
            c = F.try_variant_get(node, path, "string")
        elif isinstance(f.dataType, T.StringType):
            part = F.try_variant_get(node, path, "variant")
            nested = F.schema_of_variant(part).startswith("OBJECT") | F.schema_of_variant(part).startswith("ARRAY")
            c = F.when(nested, F.to_json(part)).otherwise(F.try_variant_get(node, path, "string"))
        else:
            c = F.try_variant_get(node, path, f.dataType.simpleString())
        out.append(c.alias(f.name))
    return out


_AUDIT = tuple(name for name, _ in S.AUDIT)


def explode_plan_entries(plans: DataFrame, doc_col: str = "doc", project_col: str = "project_id") -> DataFrame:
    """Runs nested in plan documents (``entries[].runs[]``) as run records with
    every declared run column, stamped with the plan id and project id. A
    document or an entry without runs (or with something else in their place)
    yields nothing. Both explodes are inner, row-local (no shuffle)."""
    p = plans.select(F.col(project_col).alias("project_id"), F.try_parse_json(F.col(doc_col)).alias("p"))
    e = p.select("project_id", F.try_variant_get("p", "$.id", "bigint").alias("plan_id"),
                 F.explode(F.try_variant_get("p", "$.entries", "array<variant>")).alias("entry"))
    r = e.select("project_id", "plan_id", F.explode(F.try_variant_get("entry", "$.runs", "array<variant>")).alias("run"))
    runs = r.select(*_declared(F.col("run"), S.RAW_RUNS, ("plan_id", "project_id", *_AUDIT)), "plan_id", "project_id")
    return epoch_normalize(runs)


def document_records(docs: DataFrame, entity: str, doc_col: str = "doc", project_col: str = "project_id") -> DataFrame:
    """Detail documents of plans or milestones as records of ``entity``: its
    declared columns, the project that they were fetched for, and all their
    ``custom_*`` keys in ``custom_fields``. Text that is no JSON object gives
    no record."""
    d = collect_custom_fields(docs, doc_col, "_custom")
    d = d.select(F.col(project_col).alias("project_id"), "_custom", F.try_parse_json(F.col(doc_col)).alias("d"))
    d = d.where(F.schema_of_variant("d").startswith("OBJECT"))
    columns = _declared(F.col("d"), S.BRONZE[entity], ("project_id", "custom_fields", *_AUDIT))
    return epoch_normalize(d.select(*columns, "project_id", F.col("_custom").alias("custom_fields")))


def stamp_parent(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str = "id",
                 stamp: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """Children take columns (``project_id`` by default) from their parent; a
    child without a parent stays, with NULLs. ``parents`` has one row per key."""
    p = parents.select(F.col(parent_key).alias("_parent"), *[F.col(c).alias(f"_p_{c}") for c in stamp])
    j = children.drop(*[c for c in stamp if c in children.columns and c != child_key]).join(
        p, F.col(child_key) == F.col("_parent"), "left")
    return j.select(*[c for c in children.columns if c not in stamp or c == child_key],
                    *[F.col(f"_p_{c}").alias(c) for c in stamp]).drop("_parent")


def _placed_cases(cases: DataFrame, suites: DataFrame, projects: DataFrame) -> DataFrame:
    s = suites.select(F.col("id").alias("s_id"), F.col("project_id").alias("s_project_id"))
    p = projects.select(F.col("id").alias("p_id"), F.coalesce(F.col("suite_mode"), F.lit(1)).alias("suite_mode"))
    return cases.join(s, F.col("suite_id") == F.col("s_id"), "left").join(p, F.col("s_project_id") == F.col("p_id"), "left")


def cases_by_suite_mode(cases: DataFrame, suites: DataFrame, projects: DataFrame) -> DataFrame:
    """Cases with the project they were fetched for. Multi-suite projects
    (mode 3) fetch per suite, so the case takes the suite's id; other modes
    fetch per project and keep the case's own suite id. A missing mode
    counts as 1; cases whose project is unknown are skipped (and listed by
    ``unplaced_cases``)."""
    return _placed_cases(cases, suites, projects).where("p_id IS NOT NULL").select(
        F.col("id"),
        F.col("p_id").alias("project_id"),
        F.when(F.col("suite_mode") == 3, F.col("s_id")).otherwise(F.col("suite_id")).alias("suite_id"),
        "suite_mode",
    )


def unplaced_cases(cases: DataFrame, suites: DataFrame, projects: DataFrame) -> DataFrame:
    """The cases that ``cases_by_suite_mode`` skips, with the reason."""
    reason = F.when(F.col("s_id").isNull(), F.lit("unknown suite")).otherwise(F.lit("unknown project"))
    return _placed_cases(cases, suites, projects).where("p_id IS NULL").select("id", "suite_id", reason.alias("reason"))


CASE_PAGE = T.StructType([T.StructField("cases", T.ArrayType(T.StructType([f for f in S.RAW_CASES.fields if f.name not in _AUDIT]))),
                          T.StructField("_broken", T.StringType())])


def _parsed_pages(pages: DataFrame, body_col: str) -> DataFrame:
    """Pages with their parsed cases and, where the text does not parse as a
    page of cases, the reason."""
    got = F.from_json(F.col(body_col), CASE_PAGE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    why = F.when(F.col(body_col).isNull(), "no response").when(F.col("_page._broken").isNotNull(), "not a page of cases") \
           .when(F.col("_page.cases").isNull(), "no list of cases")
    return pages.withColumn("_page", got).withColumn("reason", why)


def cases_from_pages(pages: DataFrame, body_col: str = "body") -> DataFrame:
    """Cases of the fetched pages (``project_id``, ``suite_id`` of a multi-suite
    fetch or NULL, JSON text): each takes its page's project, and the suite it
    was fetched by. A page that failed costs its own cases only; it is listed
    by ``skipped_pages``, so that no case is lost silently."""
    p = _parsed_pages(pages, body_col).where("reason IS NULL")
    c = p.select(F.col("project_id"), F.col("suite_id").alias("_suite"), F.explode("_page.cases").alias("c"))
    return c.select("c.*", "project_id", "_suite").withColumn("suite_id", F.coalesce("_suite", "suite_id")).drop("_suite")


def skipped_pages(pages: DataFrame, body_col: str = "body") -> DataFrame:
    """The fetched pages that could not be read, with reason and text."""
    return _parsed_pages(pages, body_col).where("reason IS NOT NULL").drop("_page")


def scoped_runs(raw_runs: DataFrame, projects: tuple[int, ...] = C.SYNCED_TEST_PROJECTS) -> DataFrame:
    """Run ids of the projects whose tests and results are synced, with the
    number of raw rows per id (raw runs repeat ids)."""
    return (raw_runs.where(F.col("project_id").isin(*projects))
            .groupBy("id", "project_id").agg(F.count(F.lit(1)).alias("n_rows")))


ISSUE_DOC = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("key", T.StringType()),
    T.StructField("fields", T.StructType([
        T.StructField("summary", T.StringType()),
        T.StructField("status", T.StructType([T.StructField("name", T.StringType())])),
        T.StructField("priority", T.StructType([T.StructField("name", T.StringType())])),
        T.StructField("assignee", T.StructType([T.StructField("displayName", T.StringType())])),
        T.StructField("reporter", T.StructType([T.StructField("displayName", T.StringType())])),
        T.StructField("resolution", T.StructType([T.StructField("name", T.StringType())])),
        T.StructField("created", T.StringType()), T.StructField("updated", T.StringType()),
    ])),
])
TRACKER_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSZ"


def _tracker_ts(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit(TRACKER_TIME_FORMAT)).cast("timestamp_ntz")


def issue_flatten(docs: DataFrame, base_url: str, doc_col: str = "doc") -> DataFrame:
    """Nested tracker issues → the flat issue columns. Missing nested
    objects give NULL; offset timestamps are converted to UTC; text that
    does not parse is kept in ``created_raw`` / ``updated_raw`` (a typed
    column cannot hold both)."""
    d = docs.select(F.from_json(F.col(doc_col), ISSUE_DOC).alias("i")).select("i.*")
    f = "fields"
    created, updated = _tracker_ts(F.col(f"{f}.created")), _tracker_ts(F.col(f"{f}.updated"))
    return d.select(
        "id", "key",
        F.col(f"{f}.summary").alias("summary"),
        F.col(f"{f}.status.name").alias("status"),
        F.col(f"{f}.priority.name").alias("priority"),
        created.alias("created"),
        updated.alias("updated"),
        F.col(f"{f}.assignee.displayName").alias("assignee"),
        F.col(f"{f}.reporter.displayName").alias("reporter"),
        F.col(f"{f}.resolution.name").alias("resolution"),
        F.concat(F.lit(f"{base_url}/browse/"), F.col("key")).alias("url"),
        F.when(created.isNull(), F.col(f"{f}.created")).alias("created_raw"),
        F.when(updated.isNull(), F.col(f"{f}.updated")).alias("updated_raw"),
    )


# ------------------------------------------------------------ incremental state
def _scope(df: DataFrame, column: str) -> Column:
    """The scope as text; NULL where it is missing, empty or zero: such scopes
    count as none, for reading and for writing watermarks."""
    c = F.col(column)
    none = (c == "") if dict(df.dtypes)[column] == "string" else (c == 0)
    return F.when(~none, c.cast("string"))


def _per_scope(sync_state: DataFrame, entity: str) -> tuple[DataFrame, Column]:
    """(scope, watermark) rows of an entity and the watermark of any row of it
    (pinned to the maximum, where the reference takes an arbitrary row)."""
    st = sync_state.where(F.col("entity_type") == entity)
    per = st.groupBy(F.col("scope_id").alias("_s")).agg(F.max("last_updated_at_watermark").alias("_wm"))
    return per.where("_s IS NOT NULL"), st.agg(F.max("last_updated_at_watermark").alias("_any")).scalar()


def watermark_read(sync_state: DataFrame, entity: str, scopes: DataFrame | None = None,
                   scope_col: str = "scope_id") -> DataFrame:
    """Last watermark per requested scope, 0 when there is none. Without
    scopes, and for a scope that is NULL, empty or zero, any row of the entity."""
    per, anyrow = _per_scope(sync_state, entity)
    if scopes is None:
        st = sync_state.where(F.col("entity_type") == entity)
        return st.agg(F.coalesce(F.max("last_updated_at_watermark"), F.lit(0).cast("long")).alias("watermark"))
    j = scopes.select(F.col(scope_col).cast("string").alias("scope_id"), _scope(scopes, scope_col).alias("_scope"))
    j = j.join(per, F.col("_scope") == F.col("_s"), "left")
    wm = F.when(F.col("_scope").isNull(), anyrow).otherwise(F.col("_wm"))
    return j.select("scope_id", F.coalesce(wm, F.lit(0).cast("long")).alias("watermark"))


def _epoch(c: Column) -> Column:
    return F.unix_seconds(c.cast("timestamp"))


def change_time(df: DataFrame) -> Column:
    """updated_on, else created_on (the reference falls back only when the
    key is absent; a column cannot tell absent from null)."""
    if "updated_on" in df.columns:
        return F.coalesce(F.col("updated_on"), F.col("created_on"))
    return F.col("created_on")


def incremental_extract(source: DataFrame, sync_state: DataFrame, entity: str, scope_col: str = "project_id") -> DataFrame:
    """Rows changed after their scope's watermark; a zero or missing watermark
    selects everything. One scan of the source, joined to the few state rows."""
    per, anyrow = _per_scope(sync_state, entity)
    j = source.withColumn("_scope", _scope(source, scope_col)).join(per, F.col("_scope") == F.col("_s"), "left")
    w = F.coalesce(F.when(F.col("_scope").isNull(), anyrow).otherwise(F.col("_wm")), F.lit(0))
    return j.where((w == 0) | (_epoch(change_time(source)) > w)).drop("_scope", "_s", "_wm")


def watermark_advance(extracted: DataFrame, sync_state: DataFrame, entity: str, as_of: _dt.datetime,
                      scope_col: str = "project_id", status: str = "SUCCESS") -> DataFrame:
    """New watermark per scope that received rows: the larger of the old one
    and the newest change time. Scopes without rows are not touched."""
    per, anyrow = _per_scope(sync_state, entity)
    new = extracted.groupBy(_scope(extracted, scope_col).alias("scope_id")).agg(
        F.max(_epoch(change_time(extracted))).alias("_new"))
    j = new.join(per, F.col("scope_id") == F.col("_s"), "left")
    old = F.when(F.col("scope_id").isNull(), anyrow).otherwise(F.col("_wm"))
    return j.select(
        F.lit(entity).alias("entity_type"), "scope_id",
        F.greatest(F.coalesce(old, F.lit(0).cast("long")), F.col("_new")).alias("last_updated_at_watermark"),
        ts_lit(as_of).alias("last_sync_ts"), F.lit(status).alias("status"),
    )


def watermark_advance_unscoped(extracted: DataFrame, sync_state: DataFrame, entity: str, as_of: _dt.datetime,
                               status: str = "SUCCESS") -> DataFrame:
    """Watermark of an entity synced without a scope (tracker issues): one
    row with a NULL scope; the old value is the entity's watermark read
    without a scope (a scalar subquery, no join)."""
    old = watermark_read(sync_state, entity).scalar()
    return extracted.agg(F.max(_epoch(change_time(extracted))).alias("_new")).select(
        F.lit(entity).alias("entity_type"), F.lit(None).cast("string").alias("scope_id"),
        F.greatest(F.coalesce(old, F.lit(0).cast("long")), F.col("_new")).alias("last_updated_at_watermark"),
        ts_lit(as_of).alias("last_sync_ts"), F.lit(status).alias("status"),
    )


def sync_state_merge(state: DataFrame, updates: DataFrame) -> DataFrame:
    """Upsert on (entity_type, scope_id), a NULL scope matching a NULL scope:
    old rows without an update are kept, updated keys take the new values.

    Expressed as a union of old and new rows and the newest per key
    (``row_number`` over the key, new before old): window partitioning
    groups NULL scopes together, so the match is NULL-safe without a join.
    The result is a new snapshot; writers save it to a fresh folder and
    switch to it, never overwriting the folder being read."""
    cols = [f.name for f in S.SYNC_STATE.fields]
    both = (state.select(*cols).withColumn("_new", F.lit(0))
            .unionByName(updates.select(*cols).withColumn("_new", F.lit(1))))
    w = Window.partitionBy("entity_type", "scope_id").orderBy(F.col("_new").desc())
    return both.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).select(*cols)


def sync_state_report(state: DataFrame) -> DataFrame:
    return state.select("entity_type", "last_sync_ts", "status", "last_updated_at_watermark").orderBy(
        F.col("last_sync_ts").desc_nulls_last(), "entity_type", F.col("last_updated_at_watermark").desc_nulls_last())


def ingest_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows landed per entity and load (audit stamp)."""
    frames = [df.groupBy(F.col("_extracted_at").alias("load")).agg(F.count(F.lit(1)).alias("rows"))
              .select(F.lit(name).alias("entity"), "load", "rows") for name, df in tables.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
