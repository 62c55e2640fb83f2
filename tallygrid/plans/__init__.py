"""Registered queries: name -> callable(spark, sf_dir), and their DuckDB oracles."""

from __future__ import annotations

from tallygrid.plans import adapters, baseline, batches, corpus, custom, dumps, evaluation, panel, relational, scorers, scoring, stored

TABLE = {**scoring.TABLE, **corpus.TABLE, **panel.TABLE, **custom.TABLE, **baseline.TABLE, **relational.TABLE, **evaluation.TABLE, **batches.TABLE, **scorers.TABLE, **dumps.TABLE, **adapters.TABLE, **stored.TABLE}
QUERIES = {name: query for name, (query, _) in TABLE.items()}
ORACLES = {name: sql for name, (_, sql) in TABLE.items() if sql}
flagship = scoring.summarize
