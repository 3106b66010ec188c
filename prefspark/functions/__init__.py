from prefspark.functions.core import (  # noqa: F401
    ATTRIBUTES, coin, hash_bigint, ieee_ge, ieee_lt, ieee_gt, sigmoid, log_sigmoid,
    require_columns, nan,
)
