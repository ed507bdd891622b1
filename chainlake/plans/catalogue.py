"""All queries over the operators outside the llm subpackage, with their SQL."""

from chainlake.plans import catalogue_reports, catalogue_search, catalogue_sequences, catalogue_tables, catalogue_validation  # noqa: F401
from chainlake.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
