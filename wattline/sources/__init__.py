from wattline.sources.tables import (  # noqa: F401
    read_table, readings, region_dim, admin_map, weather, holidays, as_of, preview,
)
from wattline.sources.sinks import (  # noqa: F401
    publish_forecast, write_leaderboard, metric_log, append_metrics,
)
