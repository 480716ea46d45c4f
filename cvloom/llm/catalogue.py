"""The pN_ queries and their SQL, where SQL can express them."""

from importlib import import_module

#: Modules by problem; each defines its queries as functions named pN_...
MODULES = ("p1_canonical", "p2_neardup", "p3_names", "p4_pairs", "p5_language", "p6_pii", "p7_encode", "p8_mixture", "p9_encoding")


def queries() -> dict:
    found = {}
    for name in MODULES:
        try:
            module = import_module(f"{__package__}.{name}")
        except ModuleNotFoundError as e:
            if e.name != f"{__package__}.{name}":
                raise
            continue
        prefix = name.split("_")[0] + "_"
        found |= {k: f for k, f in vars(module).items() if k.startswith(prefix) and callable(f)}
    return found


def oracle_sql() -> dict:
    """All pairs by an inverted index of words: exact, and quick enough on small tables."""
    return {"p2_found": P2_SQL}


P2_SQL = """WITH w AS (SELECT hit_id, regexp_extract_all(lower(content), '[\\p{L}\\p{Nd}]+') AS all_words FROM hits WHERE content IS NOT NULL),
d AS (SELECT hit_id, list_distinct(all_words) AS words FROM w WHERE len(all_words) >= 70),
u AS (SELECT hit_id, unnest(words) AS word FROM d), n AS (SELECT hit_id, len(words) AS n FROM d),
s AS (SELECT a.hit_id AS hit_a, b.hit_id AS hit_b, count(*) AS both_have FROM u a JOIN u b ON a.word = b.word AND a.hit_id < b.hit_id GROUP BY 1, 2)
SELECT hit_a, hit_b FROM s JOIN n x ON x.hit_id = hit_a JOIN n y ON y.hit_id = hit_b WHERE both_have >= 0.7 * (x.n + y.n - both_have)"""
