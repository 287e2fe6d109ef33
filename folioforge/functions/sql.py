"""Functions for SQL text: scalar ones and table functions (UD3), all of built-in expressions.

``SELECT b.id, n.isbn13 FROM books b, LATERAL numbers_in(b.description) AS n``
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name and definition; later ones call earlier ones.
FUNCTIONS = (
    """isbn13_check(core STRING) RETURNS STRING RETURN
       CAST((10 - aggregate(sequence(1, 12), 0, (a, i) -> a + CAST(substr(core, i, 1) AS INT) * IF(i % 2 = 1, 1, 3)) % 10) % 10 AS STRING)""",
    """isbn13_valid(c STRING) RETURNS BOOLEAN RETURN c RLIKE '^97[89][0-9]{10}$' AND isbn13_check(substr(c, 1, 12)) = substr(c, 13, 1)""",
    """isbn10_valid(c STRING) RETURNS BOOLEAN RETURN c RLIKE '^[0-9]{9}[0-9X]$'
       AND aggregate(sequence(1, 10), 0, (a, i) -> a + IF(substr(c, i, 1) = 'X', 10, CAST(substr(c, i, 1) AS INT)) * (11 - i)) % 11 = 0""",
    """isbn10_to_13(c STRING) RETURNS STRING RETURN IF(isbn10_valid(c), '978' || substr(c, 1, 9) || isbn13_check('978' || substr(c, 1, 9)), NULL)""",
    # IS8: numbers of thirteen digits with separators, tens in product paths, bare tens; at is a find's place among all, good or
    # not, and repeats stay. Scalar functions of SQL cannot stand inside a generator, so the finds are spread first.
    r"""numbers_in(said STRING) RETURNS TABLE (at INT, isbn13 STRING, via STRING) RETURN
       SELECT at, isbn13, via FROM (SELECT at, x.via AS via, CASE WHEN x.via <> 'isbn13' THEN isbn10_to_13(upper(x.m)) WHEN isbn13_valid(regexp_replace(x.m, '[^0-9]', '')) THEN regexp_replace(x.m, '[^0-9]', '') END AS isbn13
         FROM (SELECT posexplode(concat(
           transform(regexp_extract_all(coalesce(said, ''), '97[89](?:[\\s-]?[0-9]){10}', 0), m -> named_struct('m', m, 'via', 'isbn13')),
           transform(regexp_extract_all(coalesce(said, ''), '/(?:dp|gp/product)/([0-9]{9}[0-9xX])', 1), m -> named_struct('m', m, 'via', 'amazon_dp')),
           transform(regexp_extract_all(coalesce(said, ''), '(?<![0-9A-Za-z])([0-9]{9}[0-9xX])(?![0-9A-Za-z])', 1), m -> named_struct('m', m, 'via', 'isbn10'))
         )) AS (at, x))) WHERE isbn13 IS NOT NULL""",
    # JS4: strong candidates of the same title with another number than ``own``, the first of each number
    """alternatives_of(candidates ARRAY<STRUCT<pos: INT, isbn: STRING, isbn13: STRING, exact_title_match: BOOLEAN, article_insensitive_title_match: BOOLEAN, score: DOUBLE>>, own STRING, most INT) RETURNS TABLE (place INT, isbn STRING) RETURN
       SELECT place + 1, x.number FROM (SELECT posexplode(slice(filter(
           filter(transform(filter(candidates, c -> coalesce(c.score, 0) >= 0.5 AND coalesce(nullif(c.isbn, ''), nullif(c.isbn13, '')) IS NOT NULL),
             c -> named_struct('number', coalesce(nullif(c.isbn, ''), c.isbn13), 'same', coalesce(c.exact_title_match, false) OR coalesce(c.article_insensitive_title_match, false))),
             (x, i) -> array_position(transform(filter(candidates, c -> coalesce(c.score, 0) >= 0.5 AND coalesce(nullif(c.isbn, ''), nullif(c.isbn13, '')) IS NOT NULL), c -> coalesce(nullif(c.isbn, ''), c.isbn13)), x.number) = i + 1),
           x -> x.same AND x.number <> coalesce(own, '')), 1, most)) AS (place, x))""",
)


def register(spark: SparkSession) -> None:
    """Make :data:`FUNCTIONS` temporary functions of the session."""
    for f in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {f}")
