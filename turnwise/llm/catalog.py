"""All queries of the corpus operators, each with its SQL where SQL can say it."""

from turnwise.llm.registry import ORACLES, QUERIES
from turnwise.llm import catalog_chat, catalog_layout, catalog_models, catalog_pages, catalog_text, catalog_tokens  # noqa: F401 - registers

__all__ = ["ORACLES", "QUERIES"]
