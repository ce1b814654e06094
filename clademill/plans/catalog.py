"""All queries of the core, by name."""

from clademill.plans import alignments, problems

QUERIES = {**problems.QUERIES, **alignments.QUERIES}
SQL = {**problems.SQL, **alignments.SQL}
