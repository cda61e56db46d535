"""All registered queries and their SQL."""

from . import disclosures, evaluation, evidence, filings, goldsets, labels, matches, papers, promotions, statements, tables, text  # noqa: F401  they register on import
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
