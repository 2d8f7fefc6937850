from wattline.plans.catalog import REGISTRY, queries, oracle_sql  # noqa: F401
