from wattline.functions.timefn import (  # noqa: F401
    floor_minutes, floor_day, floor_hour, slot_of_day, raw_range, half_open,
    add_minutes, as_ntz,
)
from wattline.functions.calendar import calendar_columns, deepar_time_columns  # noqa: F401
from wattline.functions.safe import safe_div, nan_to_null, null_or_nan, exact_sum, exact_mean  # noqa: F401
