"""The registry of queries and their DuckDB equivalents."""

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    """Registers a function (spark, sf_dir) under its own name, beside the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register
