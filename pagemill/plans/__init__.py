"""The operators as queries: ``all_queries`` and ``all_sql``."""


def all_queries() -> dict:
    from pagemill.plans import catalog, catalog_files, catalog_flows, catalog_runs, catalog_tables  # noqa: F401  the modules fill the catalog

    return dict(catalog.QUERIES)


def all_sql() -> dict:
    all_queries()
    from pagemill.plans import catalog

    return dict(catalog.SQL)
