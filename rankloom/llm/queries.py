"""Registry of this subpackage's queries; the entry point adds it if the subpackage can be imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import p1_residue, p2_format_duplicates, p3_truncation, p4_main_body, p5_encoding, p6_tokens, p7_containers, p8_subjects


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    modules = (p1_residue, p2_format_duplicates, p3_truncation, p4_main_body, p5_encoding, p6_tokens, p7_containers, p8_subjects)
    return {name: f for m in modules for name, f in vars(m).items() if name[0] == "p" and name[1:2].isdigit() and "_" in name and callable(f)}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express; the others are tested against brute force on small fixtures."""
    from rankloom.llm.sql import ORACLES

    return dict(ORACLES)
