"""All queries, by operator, with the SQL that checks them."""

from . import core


def _load():
    from . import cases, checks, entries, intake, legend, loads, messages, pixels, report, scalars, sources, state, verdict  # noqa: F401


def queries():
    _load()
    return dict(core.QUERIES)


def oracle_sql():
    _load()
    return {name: core.full_sql(body) for name, body in core.SQL.items()}
