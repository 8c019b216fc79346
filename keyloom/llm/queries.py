"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .decontaminate import op5_leaks
from .htmltree import op7_html
from .licenses import op9_licenses
from .linededup import op3_lines
from .pieces import op8_pieces
from .quality import OP4_SQL, op4_quality
from .secrets import op2_secrets
from .simhash import op6_simhash
from .toxicity import op1_toxicity
from .warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_secrets": op2_secrets,
    "op3_lines": op3_lines,
    "op4_quality": op4_quality,
    "op5_leaks": op5_leaks,
    "op6_simhash": op6_simhash,
    "op7_html": op7_html,
    "op8_pieces": op8_pieces,
    "op9_licenses": op9_licenses,
    "op10_warc": op10_warc,
}
SQL = {"op4_quality": OP4_SQL, "op10_warc": OP10_SQL}
