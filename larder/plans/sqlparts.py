"""Common table expressions shared by the oracle statements."""

from __future__ import annotations

from larder.functions.ids import NO_VALUE

_NONE = ", ".join(f"'{x}'" for x in NO_VALUE)

#: Clean form of an id column, to be formatted with its name.
CLEAN_IDS = f"(CASE WHEN lower(regexp_replace({{0}}, '^\\s+|\\s+$', '', 'g')) IN ({_NONE}) THEN NULL ELSE lower(regexp_replace({{0}}, '^\\s+|\\s+$', '', 'g')) END)"

#: cuisine_names(raw, name): every writing of a cuisine in food_orders and what it stands for.
CUISINE_NAMES = f"""
cuisine_words AS (SELECT DISTINCT primary_cuisine AS name, regexp_replace(lower(primary_cuisine), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS k FROM vendors WHERE primary_cuisine IS NOT NULL),
cuisine_raw AS (SELECT raw, regexp_replace(lower(raw), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS k, trim(regexp_replace(lower(raw), '[\\s_.-]+', ' ', 'g')) AS squeezed FROM (SELECT DISTINCT cuisine AS raw FROM food_orders WHERE cuisine IS NOT NULL)),
cuisine_names AS (SELECT r.raw, CASE WHEN squeezed IN ({_NONE}) THEN NULL ELSE coalesce(
    (SELECT min(w.name) FROM cuisine_words w WHERE w.k = r.k), (SELECT min(w.name) FROM cuisine_words w WHERE damerau_levenshtein(w.k, r.k) <= 1), squeezed) END AS name
  FROM cuisine_raw r)
"""
