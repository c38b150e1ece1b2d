"""All groups of registered queries together."""

from . import audits, dialogue, extras, models, registry, reports, streams, study, whole  # noqa: F401

queries, oracle_sql = registry.queries, registry.oracle_sql
