"""All queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("p1_nearcopies", "p2_quality", "p3_cutoff", "p4_split", "p5_scans", "p6_pairs", "p7_leaks", "p8_encode", "p9_pack", "p10_mojibake")
QUERIES: dict = {}
ORACLE: dict = {}
for _m in _MODULES:
    _mod = import_module(f"{__package__}.{_m}")
    QUERIES.update(_mod.QUERIES)
    ORACLE.update(_mod.ORACLE)
