from qalytics.functions.columns import (  # noqa: F401
    count_if,
    day_diff,
    elapsed_days,
    json_object,
    json_value,
    json_value_in,
    listagg_distinct,
    month_key,
    parse_day,
    safe_divide,
    ts_lit,
)
