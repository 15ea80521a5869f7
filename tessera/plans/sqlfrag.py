"""SQL fragments for the DuckDB oracle, built from the same fixed patterns the
Spark functions use (tessera.functions.text), so both sides agree by
construction.  The oracle skips NFKC (DuckDB has none); no provided document
changes under NFKC, and the NFKC rule is tested on hand-made rows."""

from __future__ import annotations

from tessera.functions import text as tx


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip_ws(e: str) -> str:
    return f"regexp_replace({e}, {q(tx.EDGE_WS)}, '', 'g')"


def safe_text(e: str) -> str:
    return strip_ws(f"coalesce(CAST({e} AS VARCHAR), '')")


def clean(e: str) -> str:
    return strip_ws(f"regexp_replace({e}, {q('[' + tx.INVISIBLE_CLASS + ']')}, '', 'g')")


def norm_ws(e: str) -> str:
    return strip_ws(f"regexp_replace({e}, {q(tx.WS_RUN)}, ' ', 'g')")


def text_key(e: str) -> str:
    return f"regexp_replace(lower({strip_ws(e)}), {q(tx.WS_RUN)}, ' ', 'g')"


def truncate(e: str, n: int | None = None) -> str:
    if n is None:
        return e
    return f"CASE WHEN length({e}) > {n} THEN substring({e}, 1, {n}) ELSE {e} END"


def prepared_text(e: str, n: int | None = None) -> str:
    """T1 -> T2 -> T4 (the emptiness filter is the caller's WHERE)."""
    return truncate(norm_ws(clean(safe_text(e))), n)


def seeded_hash(seed, e: str) -> str:
    return f"md5({q(str(seed) + ':')} || CAST({e} AS VARCHAR))"


def allocate(rank: str, size: str, test_pct: int = 20, val_pct: int = 10,
             min_eval: int | None = 5) -> str:
    n_test = f"floor(({size} * {test_pct} + 50) / 100)"
    n_val = f"floor(({size} * {val_pct} + 50) / 100)"
    if min_eval is not None:
        n_test = f"(CASE WHEN {size} >= {min_eval} THEN greatest({n_test}, 1) ELSE {n_test} END)"
        n_val = f"(CASE WHEN {size} >= {min_eval} THEN greatest({n_val}, 1) ELSE {n_val} END)"
    return (f"(CASE WHEN {rank} <= {n_test} THEN 'test' "
            f"WHEN {rank} <= {n_test} + {n_val} THEN 'val' ELSE 'train' END)")
