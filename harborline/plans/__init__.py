"""Plans over the given tables: each names its query and the SQL that it must agree with."""

from harborline.plans import aggregates, assembled, evidence, incremental, matching, relations, retrieval, scalars, scoring, series

PLANS = [series.R, scalars.R, relations.R, aggregates.R, matching.R, retrieval.R, scoring.R, assembled.R, evidence.R, incremental.R]
