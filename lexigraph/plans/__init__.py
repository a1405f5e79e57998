"""Registered queries over the derived views."""

from importlib import import_module

_MODULES = ("cooccur_queries", "filter_queries", "join_queries", "graph_queries", "search_queries",
            "text_queries", "metric_queries", "window_queries", "mutation_queries", "discovery_queries",
            "exchange_queries", "stream_queries")


def _load():
    from lexigraph.plans import registry

    for name in _MODULES:
        import_module(f"lexigraph.plans.{name}")
    return registry


def all_queries():
    return _load().all_queries()


def all_sql():
    return _load().all_sql()
