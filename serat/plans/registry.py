"""All core queries and their SQL."""

from __future__ import annotations

from serat.plans import news, pieces, training_data

FLAGSHIP = "topic_outliers"
QUERIES = {**news.QUERIES, **pieces.QUERIES, **training_data.QUERIES}
ORACLES = {**news.ORACLES, **pieces.ORACLES, **training_data.ORACLES}
