"""Registered queries, each with the SQL that must give the same rows where SQL can say it."""

from quarrylight.queries import answers, dates, extract, graph, interpret, match, metadata, normal, offices, dialog, grounded, people, plans, retrieval, state, tables, verify, web  # noqa: F401
from quarrylight.queries.base import QUERIES, SQL  # noqa: F401
