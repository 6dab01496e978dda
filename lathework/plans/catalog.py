"""All queries over the driver's tables by name, and the SQL that gives the same rows in DuckDB."""

from ..streaming import policies
from . import q_contract, q_files, q_meta, q_net, q_plan, q_runs, q_text

QUERIES = {**q_plan.QUERIES, **q_net.QUERIES, **q_text.QUERIES, **q_meta.QUERIES, **q_runs.QUERIES, **q_files.QUERIES, **q_contract.QUERIES, **policies.QUERIES}
SQL = {**q_plan.SQL, **q_net.SQL, **q_text.SQL, **q_meta.SQL, **q_runs.SQL, **q_files.SQL, **q_contract.SQL, **policies.SQL}
