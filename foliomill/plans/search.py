"""Catalog search: scans, filters through links, predicate languages, paging, joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.operators import predicates as P
from foliomill.operators import relations as R
from foliomill.registry import query
from foliomill.sources import catalog as C
from foliomill.sources import remote

#: roles of the driver tables, for SQL
ROLES = """
books AS (SELECT p_partkey AS id, p_name AS title, p_brand AS publisher, p_brand AS series, CAST(p_size AS DOUBLE) AS series_index, p_type AS tag, p_retailprice AS size FROM part),
authors AS (SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation, s_acctbal AS balance FROM supplier),
links AS (SELECT DISTINCT l_partkey AS book, l_suppkey AS author FROM lineitem),
ratings AS (SELECT l_partkey AS book, min(l_linenumber) AS rating FROM lineitem WHERE l_linenumber <= 5 GROUP BY l_partkey)
"""


def sql(body: str) -> str:
    return f"WITH {ROLES} {body}"


def linked(s: SparkSession, d: str) -> dict[str, R.Linked]:
    """Authors, tags, series and publishers of the books as link and entity tables."""
    b = C.books(s, d)
    out = {"authors": R.Linked(C.book_authors(s, d), C.authors(s, d).select("id", "name"), "author")}
    for kind, column in (("tags", "tag"), ("series", "series"), ("publishers", "publisher")):
        entity = b.select(F.col(column).alias("name")).distinct().withColumn("id", F.xxhash64("name"))
        link = b.select(F.col("id").alias("book"), F.xxhash64(column).alias("k"))
        out[kind] = R.Linked(link, entity, "k")
    return out


def _filtered(s: SparkSession, d: str, **f) -> DataFrame:
    return R.apply_filters(C.books(s, d), R.BookFilters(**f), linked(s, d), ratings=C.ratings(s, d)).select("id", "title")


def _filter_query(name: str, where: str, **f) -> None:
    query(sql(f"SELECT id, title FROM books b WHERE {where}"), name)(lambda s, d: _filtered(s, d, **f))


_BY = "id IN (SELECT book FROM links JOIN authors a ON a.id = author WHERE {})"
_filter_query("filter_title", "title ILIKE '%bolt%'", title="bolt")
_filter_query("filter_title_wildcard", "title ILIKE '%r_d%'", title="r_d")
_filter_query("filter_any_field", f"title ILIKE '%ring%' OR series ILIKE '%ring%' OR tag ILIKE '%ring%' OR {_BY.format("name ILIKE '%ring%'")}", search="ring")
_filter_query("filter_author_id", "id IN (SELECT book FROM links WHERE author = 7)", author_id=7)
_filter_query("filter_author_words", _BY.format("name ILIKE '%supplier%' AND name ILIKE '%0013%'"), author="supplier 0013")
_filter_query("filter_authors_any", _BY.format("(name ILIKE '%0003%') OR (name ILIKE '%Supplier%' AND name ILIKE '%0017%')"), authors=["0003", "Supplier 0017"])
_filter_query("filter_exclude_authors", "NOT " + _BY.format("name ILIKE '%0005%' OR name ILIKE '%0000009%'"), exclude_authors=["0005", "0000009"])
_filter_query("filter_series", "series ILIKE '%brand#1%'", series="brand#1")
_filter_query("filter_exclude_series", "NOT (series ILIKE '%#1%' OR series ILIKE '%#2%')", exclude_series=["#1", "#2"])
_filter_query("filter_tag", "tag ILIKE '%eco%'", tag="eco")
_filter_query("filter_tags_any", "tag ILIKE '%large%' OR tag ILIKE '%small%'", tags=["large", "small"])
_filter_query("filter_exclude_tags", "NOT (tag ILIKE '%promo%' OR tag ILIKE '%ard%')", exclude_tags=["promo", "ard"])
_filter_query("filter_publisher", "publisher ILIKE '%#3%'", publisher="#3")
_filter_query("filter_publishers_any", "publisher ILIKE '%#4%' OR publisher ILIKE '%#5%'", publishers=["#4", "#5"])
_filter_query("filter_has_publisher", "publisher IS NOT NULL AND publisher <> ''", has_publisher=True)
_filter_query("filter_no_publisher", "publisher IS NULL OR publisher = ''", has_publisher=False)
_filter_query("filter_unrated", "id NOT IN (SELECT book FROM ratings)", unrated=True)
_filter_query("filter_rating", "id IN (SELECT book FROM ratings WHERE rating = 2)", rating=2)
_filter_query("filter_rating_range", "id IN (SELECT book FROM ratings WHERE rating BETWEEN 2 AND 4)", min_rating=2, max_rating=4)
_filter_query("filter_equal_and_in", "tag IN ('PROMO', 'LARGE') AND series_index = 7", equal={"tag": ["PROMO", "LARGE"], "series_index": 7.0})
_filter_query("filter_combined", f"title ILIKE '%re%' AND tag ILIKE '%s%' AND {_BY.format("name ILIKE '%00001%'")} AND NOT publisher ILIKE '%#1%'", title="re", tags=["s"], authors=["00001"], exclude_series=["#1"])


@query(sql("""SELECT b.id, b.title, b.publisher, count(*) AS n_authors FROM books b JOIN links l ON l.book = b.id
WHERE title ILIKE '%r%' AND NOT series ILIKE '%#1_' AND b.id IN (SELECT book FROM links JOIN authors a ON a.id = author WHERE name ILIKE '%supplier%' AND name ILIKE '%0001%')
GROUP BY ALL ORDER BY n_authors DESC, b.id LIMIT 20"""))
def catalog_search(s: SparkSession, d: str) -> DataFrame:
    f = R.BookFilters(title="r", author="supplier 0001", exclude_series=["#1_"], limit=20)
    hits = R.apply_filters(C.books(s, d), f, linked(s, d))
    n = C.book_authors(s, d).groupBy(F.col("book").alias("id")).agg(F.count(F.lit(1)).alias("n_authors"))
    return R.page(hits.join(n, "id").select("id", "title", "publisher", "n_authors").orderBy(F.desc("n_authors"), "id"), f.limit, f.offset)


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderdate >= DATE '1996-02-10' AND o_orderdate < DATE '1996-03-16'")
def filter_date_range_inclusive(s: SparkSession, d: str) -> DataFrame:
    return C.table(s, d, "orders").filter(R.day_range(F.col("o_orderdate"), "1996-02-10", "1996-03-15")).select(F.col("o_orderkey").alias("id"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderdate < DATE '1995-01-11'")
def filter_bad_date_ignored(s: SparkSession, d: str) -> DataFrame:
    return C.table(s, d, "orders").filter(R.day_range(F.col("o_orderdate"), "not a day", "1995-01-10")).select(F.col("o_orderkey").alias("id"))


@query("SELECT doc_id AS id FROM documents WHERE text ILIKE '%license%'")
def filter_comment(s: SparkSession, d: str) -> DataFrame:
    return C.table(s, d, "documents").filter(R.like(F.col("text"), "license")).select(F.col("doc_id").alias("id"))


@query("SELECT doc_id AS id, quality IS NOT NULL AS has_description FROM documents LEFT JOIN labels USING (doc_id)")
def filter_has_description(s: SparkSession, d: str) -> DataFrame:
    l = C.table(s, d, "labels").select("doc_id", F.lit(True).alias("has")).dropDuplicates(["doc_id"])  # noqa: E741
    return C.table(s, d, "documents").join(l, "doc_id", "left").select(F.col("doc_id").alias("id"), F.coalesce("has", F.lit(False)).alias("has_description"))


@query(sql("SELECT id, name FROM authors WHERE name ILIKE 's%' ORDER BY name, id"))
def list_by_letter(s: SparkSession, d: str) -> DataFrame:
    return R.by_letter(C.authors(s, d), "name", "S").select("id", "name")


@query(sql("SELECT id, title, publisher FROM books WHERE id = 42"))
def get_by_id(s: SparkSession, d: str) -> DataFrame:
    b = C.books(s, d).withColumn("uuid", F.md5(F.col("id").cast("string").cast("binary")))
    return R.by_key_or_uuid(b, "42").select("id", "title", "publisher")


@query(sql("SELECT id, title FROM books WHERE md5(CAST(id AS VARCHAR)) = md5('43')"))
def get_by_uuid(s: SparkSession, d: str) -> DataFrame:
    import hashlib

    b = C.books(s, d).withColumn("uuid", F.md5(F.col("id").cast("string").cast("binary")))
    return R.by_key_or_uuid(b, hashlib.md5(b"43").hexdigest()).select("id", "title")


@query(sql("SELECT id, title FROM books WHERE id IN (5, 3, 99, 17)"))
def get_by_ids(s: SparkSession, d: str) -> DataFrame:
    return remote.by_ids(C.books(s, d), [5, 3, 99, -4, 17]).select("id", "title")


@query(sql("SELECT id, name FROM authors WHERE lower(name) = 'supplier#000000007'"))
def get_by_name(s: SparkSession, d: str) -> DataFrame:
    return C.authors(s, d).filter(F.lower("name") == "supplier#000000007").select("id", "name")


@query(sql("SELECT id, title FROM books ORDER BY title, id LIMIT 25 OFFSET 50"))
def page_three(s: SparkSession, d: str) -> DataFrame:
    return R.page(R.ordered(C.books(s, d), "title"), 25, 50).select("id", "title")


@query(sql("SELECT count(*) AS total, 3 AS page, 25 AS page_size, CAST(greatest(1, ceil(count(*) / 25)) AS BIGINT) AS total_pages FROM books"))
def page_envelope(s: SparkSession, d: str) -> DataFrame:
    out = R.page_info(C.books(s, d), 25, 50)
    return out.withColumn("page", F.col("page").cast("int")).withColumn("page_size", F.col("page_size").cast("int"))


@query(sql("SELECT b.id, b.title, rating FROM books b LEFT JOIN ratings r ON r.book = b.id ORDER BY rating DESC NULLS LAST, b.id LIMIT 30"))
def sort_by_rating(s: SparkSession, d: str) -> DataFrame:
    r = C.ratings(s, d).select(F.col("book").alias("id"), "rating")
    return R.ordered(C.books(s, d).join(r, "id", "left").select("id", "title", "rating"), "rating", descending=True).limit(30)


@query(sql("SELECT id, title, size FROM books ORDER BY size DESC, id LIMIT 15"))
def sort_by_named_field(s: SparkSession, d: str) -> DataFrame:
    return R.ordered(C.books(s, d), "bytes", descending=True, columns={"bytes": "size"}).limit(15).select("id", "title", "size")


@query(sql("SELECT id, title FROM books ORDER BY title, id LIMIT 12"))
def sort_by_unknown_field(s: SparkSession, d: str) -> DataFrame:
    return R.ordered(C.books(s, d), "no_such_field").limit(12).select("id", "title")


@query("SELECT o_orderkey AS id, o_orderdate AS added FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def recent_additions(s: SparkSession, d: str) -> DataFrame:
    return C.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("added")).orderBy(F.desc("added"), "id").limit(10)


@query(sql("SELECT b.id, b.title, rating FROM books b JOIN ratings r ON r.book = b.id ORDER BY rating DESC, b.id LIMIT 20"))
def priority_list(s: SparkSession, d: str) -> DataFrame:
    return C.books(s, d).join(C.ratings(s, d).select(F.col("book").alias("id"), "rating"), "id").select("id", "title", "rating").orderBy(F.desc("rating"), "id").limit(20)


@query()
def random_pick(s: SparkSession, d: str) -> DataFrame:
    """One of the first hundred matches, at random under a seed."""
    hits = C.books(s, d).filter(R.like(F.col("title"), "ring")).orderBy("id").limit(100)
    return hits.orderBy(F.rand(7)).limit(1).select("id", "title")


@query(sql("SELECT count(*) AS n, count(*) > 0 AS found FROM books WHERE tag = 'PROMO'"))
def count_and_exists(s: SparkSession, d: str) -> DataFrame:
    return C.books(s, d).filter("tag = 'PROMO'").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) > 0).alias("found"))


@query(sql("SELECT id FROM books WHERE title ILIKE '%red%' OR title ILIKE '%anvil%' OR publisher ILIKE '%red%' OR publisher ILIKE '%anvil%'"))
def search_fields_by_terms(s: SparkSession, d: str) -> DataFrame:
    test = reduce(lambda a, b: a | b, [R.like(F.col(c), t) for c in ("title", "publisher") for t in "red anvil".split()])
    return C.books(s, d).filter(test).select("id")


# --- predicate languages ---------------------------------------------------------------


def _tagged(s: SparkSession, d: str) -> DataFrame:
    """Books with list, null and struct columns to test predicates on."""
    r = C.ratings(s, d).select(F.col("book").alias("id"), "rating")
    b = C.books(s, d).join(r, "id", "left")
    return b.withColumn("tags", F.array(F.lower("tag"), F.split_part("title", F.lit(" "), F.lit(2)))).withColumn("ids", F.struct(F.concat(F.lit("k"), F.col("id").cast("string")).alias("isbn")))


_TAGGED_SQL = "t AS (SELECT b.*, r.rating, [lower(tag), string_split(title, ' ')[2]] AS tags, 'k' || CAST(id AS VARCHAR) AS isbn FROM books b LEFT JOIN ratings r ON r.book = b.id)"

#: every operator of the search language: name -> (field, operator, value, the same in SQL)
SEARCH_OPS = {
    "eq": ("title", "=", "red bolt", "title = 'red bolt'"), "ne": ("rating", "!=", 3, "rating IS DISTINCT FROM 3"), "gt": ("rating", ">", 3, "coalesce(rating > 3, false)"), "lt": ("size", "<", 905.0, "size < 905"),
    "ge": ("rating", ">=", 3, "coalesce(rating >= 3, false)"), "le": ("rating", "<=", 1, "coalesce(rating <= 1, false)"), "contains": ("tags", "contains", "BOL", "len(list_filter(tags, lambda x: lower(x) LIKE '%bol%')) > 0"),
    "not_contains": ("title", "not_contains", "RED", "NOT lower(title) LIKE '%red%'"), "starts": ("title", "starts_with", "BLUE", "lower(title) LIKE 'blue%'"), "ends": ("title", "ends_with", "Gear", "lower(title) LIKE '%gear'"),
    "regex": ("title", "regex", "^(red|hot) .*g", "regexp_matches(title, '(?i)^(red|hot) .*g')"), "in": ("tag", "in", ["PROMO", "SMALL"], "tag IN ('PROMO', 'SMALL')"), "not_in": ("rating", "not_in", [1, 2], "rating IS NULL OR rating NOT IN (1, 2)"),
    "exists": ("rating", "exists", None, "rating IS NOT NULL"), "not_exists": ("rating", "not_exists", None, "rating IS NULL"), "type_error": ("title", ">", 3, "false"), "unknown_field": ("nothing", "not_contains", "x", "true"),
}


@query(sql(f", {_TAGGED_SQL} SELECT id, {', '.join(f'({v[3]}) AS {k}' for k, v in SEARCH_OPS.items())} FROM t").replace(") , t", "), t").replace("\n , t", ", t").replace("\n, t AS", ", t AS"))
def dsl_search_operators(s: SparkSession, d: str) -> DataFrame:
    t = _tagged(s, d)
    return t.select("id", *[P.search(t, f, op, v).alias(k) for k, (f, op, v, _) in SEARCH_OPS.items()])


RULE_OPS = {
    "eq": ("tag", "==", "PROMO", "tag = 'PROMO'"), "ne": ("rating", "!=", 2, "rating IS DISTINCT FROM 2"), "gt": ("size", ">", 950.0, "size > 950"), "lt": ("rating", "<", 2, "coalesce(rating < 2, false)"), "ge": ("rating", ">=", 4, "coalesce(rating >= 4, false)"), "le": ("size", "<=", 901.0, "size <= 901"),
    "contains_text": ("title", "contains", "ed b", "contains(title, 'ed b')"), "contains_list": ("tags", "contains", "bolt", "list_contains(tags, 'bolt')"), "not_contains": ("tags", "not_contains", "Bolt", "NOT list_contains(tags, 'Bolt')"),
    "regex": ("title", "regex", "RING$", "regexp_matches(title, '(?i)RING$')"), "in": ("rating", "in", [1, 5], "coalesce(rating IN (1, 5), false)"), "not_in": ("tag", "not_in", ["LARGE"], "tag NOT IN ('LARGE')"),
}


@query(sql(f", {_TAGGED_SQL} SELECT id, {', '.join(f'({v[3]}) AS {k}' for k, v in RULE_OPS.items())} FROM t").replace("\n, t AS", ", t AS"))
def dsl_rule_operators(s: SparkSession, d: str) -> DataFrame:
    t = _tagged(s, d)
    return t.select("id", *[P.rule(t, f, op, v).alias(k) for k, (f, op, v, _) in RULE_OPS.items()])


CONDITION_OPS = {
    "equals": ("ids.isbn", "equals", "k12", "isbn = 'k12'"), "not_equals": ("ids.isbn", "not_equals", "k12", "isbn <> 'k12'"), "contains": ("tags", "contains", "bolt", "list_contains(tags, 'bolt')"), "not_contains": ("title", "not_contains", "red", "NOT contains(title, 'red')"),
    "starts": ("title", "starts_with", "red", "starts_with(title, 'red')"), "ends": ("ids.isbn", "ends_with", "7", "isbn LIKE '%7'"), "regex": ("title", "matches_regex", "^b.*t$", "regexp_matches(title, '^b.*t$')"), "more": ("rating", "greater_than", 2, "coalesce(rating > 2, false)"),
    "less": ("size", "less_than", 910, "size < 910"), "is_set": ("rating", "is_set", None, "rating IS NOT NULL"), "is_not_set": ("rating", "is_not_set", None, "rating IS NULL"), "no_path": ("ids.none", "is_set", None, "false"),
}


@query(sql(f", {_TAGGED_SQL} SELECT id, {', '.join(f'({v[3]}) AS {k}' for k, v in CONDITION_OPS.items())} FROM t").replace("\n, t AS", ", t AS"))
def dsl_condition_operators(s: SparkSession, d: str) -> DataFrame:
    t = _tagged(s, d)
    return t.select("id", *[P.condition(t, f, op, v).alias(k) for k, (f, op, v, _) in CONDITION_OPS.items()])


@query(sql("SELECT id, title FROM books WHERE title ILIKE '%red%' OR tag IN ('PROMO')"))
def dsl_any_of(s: SparkSession, d: str) -> DataFrame:
    b = C.books(s, d)
    return b.filter(P.search_all(b, [("title", "contains", "red"), ("tag", "in", ["PROMO"])], must_match_all=False)).select("id", "title")


@query(sql("SELECT id, title FROM books WHERE series = 'Brand#7' ORDER BY id LIMIT 20 OFFSET 5"))
def smart_collection(s: SparkSession, d: str) -> DataFrame:
    c = P.Collections()
    name = c.create_series("Brand#7")
    return R.page(c.query(name, C.books(s, d)).orderBy("id"), 20, 5).select("id", "title")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) - INTERVAL 90 DAY FROM orders)")
def smart_collection_recent(s: SparkSession, d: str) -> DataFrame:
    o = C.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("added_at"))
    now = o.agg(F.max("added_at")).first()[0]  # the clock of the data
    c = P.Collections()
    return c.query(c.create_recent(90, now), o).select("id")


RULES = [
    {"name": "promo", "priority": 5, "conditions": [{"field": "tag", "operator": "equals", "value": "PROMO"}]},
    {"name": "red", "priority": 9, "conditions": [{"field": "title", "operator": "starts_with", "value": "red"}]},
    {"name": "off", "priority": 10, "enabled": False, "conditions": []},
    {"name": "late", "priority": 1, "conditions": [{"field": "series_index", "operator": "greater_than", "value": 25}, {"field": "tag", "operator": "not_equals", "value": "PROMO"}]},
]


@query(sql("SELECT id, concat_ws(',', CASE WHEN starts_with(title, 'red') THEN 'red' END, CASE WHEN tag = 'PROMO' THEN 'promo' END, CASE WHEN series_index > 25 AND tag <> 'PROMO' THEN 'late' END) AS rules FROM books"))
def organisation_rules(s: SparkSession, d: str) -> DataFrame:
    b = C.books(s, d)
    return b.select("id", F.array_join(P.matching_rules(b, RULES), ",").alias("rules"))


# --- joins ------------------------------------------------------------------------------


@query(sql("SELECT b.id, string_agg(a.name, '|' ORDER BY a.name) AS names FROM books b JOIN links l ON l.book = b.id JOIN authors a ON a.id = l.author GROUP BY b.id"))
def joined_author_names(s: SparkSession, d: str) -> DataFrame:
    return R.joined_names(C.book_authors(s, d), C.authors(s, d), "author")


@query(sql("SELECT b.id, title, tag, coalesce(rating, 0) AS rating, coalesce(n, 0) AS n_authors, coalesce(first_author, '') AS first_author FROM books b LEFT JOIN ratings r ON r.book = b.id LEFT JOIN (SELECT book, count(*) AS n, min_by(name, a.id) AS first_author FROM links JOIN authors a ON a.id = author GROUP BY book) x ON x.book = b.id"))
def denormalised_books(s: SparkSession, d: str) -> DataFrame:
    a = R.gathered(C.book_authors(s, d), C.authors(s, d), "author", "authors")
    r = C.ratings(s, d).select(F.col("book").alias("id"), "rating")
    out = C.books(s, d).join(r, "id", "left").join(a, "id", "left")
    return out.select("id", "title", "tag", F.coalesce("rating", F.lit(0)).alias("rating"), F.coalesce(F.size("authors"), F.lit(0)).cast("long").alias("n_authors"), F.coalesce(F.get("authors", F.lit(0))["name"], F.lit("")).alias("first_author"))


@query(sql("SELECT b.id, b.title FROM books b JOIN links l ON l.book = b.id WHERE l.author = 3 ORDER BY b.title, b.id LIMIT 20 OFFSET 10"))
def books_by_author(s: SparkSession, d: str) -> DataFrame:
    hits = R.having(C.books(s, d), C.book_authors(s, d).filter("author = 3").select(F.col("book").alias("id")))
    return R.page(hits.orderBy("title", "id"), 20, 10).select("id", "title")


@query(sql("SELECT id, title, series_index FROM books WHERE series = 'Brand#5' ORDER BY series_index, id"))
def books_by_series(s: SparkSession, d: str) -> DataFrame:
    return C.books(s, d).filter("series = 'Brand#5'").orderBy("series_index", "id").select("id", "title", "series_index")


@query("SELECT c_custkey AS id, count(o_orderkey) AS orders, count(DISTINCT o_orderstatus) AS kinds FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def two_grouped_counts(s: SparkSession, d: str) -> DataFrame:
    o = C.table(s, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("orders"), F.countDistinct("o_orderstatus").alias("kinds"))
    none = F.lit(0).cast("long")
    return C.table(s, d, "customer").select(F.col("c_custkey").alias("id")).join(o, "id", "left").select("id", F.coalesce("orders", none).alias("orders"), F.coalesce("kinds", none).alias("kinds"))


@query(sql("SELECT a.id, a.name, count(l.book) AS books FROM authors a LEFT JOIN links l ON l.author = a.id WHERE name ILIKE '%001%' OR CAST(nation AS VARCHAR) ILIKE '%1%' GROUP BY ALL ORDER BY books DESC, name LIMIT 10"))
def search_authors(s: SparkSession, d: str) -> DataFrame:
    a = C.authors(s, d).filter(R.like(F.col("name"), "001") | R.like(F.col("nation").cast("string"), "1"))
    n = C.book_authors(s, d).groupBy(F.col("author").alias("id")).agg(F.count(F.lit(1)).alias("books"))
    return a.join(n, "id", "left").select("id", "name", F.coalesce("books", F.lit(0)).cast("long").alias("books")).orderBy(F.desc("books"), "name").limit(10)


@query(sql("SELECT id, title FROM books b WHERE NOT EXISTS (SELECT 1 FROM links WHERE book = b.id)"))
def books_without_author(s: SparkSession, d: str) -> DataFrame:
    return R.lacking(C.books(s, d), C.book_authors(s, d).select(F.col("book").alias("id"))).select("id", "title")


@query("SELECT 'nation' || CAST(c_nationkey AS VARCHAR) AS library_name, c_custkey AS id FROM customer WHERE c_name ILIKE '%9%' ORDER BY library_name, id LIMIT 50")
def cross_library_search(s: SparkSession, d: str) -> DataFrame:
    """One library for every nation that has customers, searched in one scan."""
    c = C.table(s, d, "customer").filter("c_nationkey is not null").select(F.concat(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("library_name"), F.col("c_custkey").alias("id"), "c_name")
    return R.within(c, lambda df: df.filter(R.like(F.col("c_name"), "9"))).select("library_name", "id")


@query("SELECT user_id AS user, event_id AS id, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 ORDER BY max(value) DESC, 1 LIMIT 3)) WHERE rank <= 5")
def lateral_top_k(s: SparkSession, d: str) -> DataFrame:
    from foliomill.operators.vectors import top_groups

    e = C.sessions(s, d).select("user", "id", F.col("minutes").alias("value"), (-F.col("minutes")).alias("cost"))
    return top_groups(e, "user", "cost", 3, 5).select("user", "id", "value", F.col("rank").cast("long").alias("rank"))


@query("SELECT p_partkey AS id, p_name AS title FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AND p_size <= 5 ORDER BY p_name, p_partkey LIMIT 40")
def raw_sql_scan(s: SparkSession, d: str) -> DataFrame:
    C.load(s, d, ("part", "lineitem"))
    return C.rows(s, "SELECT p_partkey AS id, p_name AS title FROM part LEFT SEMI JOIN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') ON p_partkey = l_partkey WHERE p_size <= 5 ORDER BY title, id LIMIT 40")


@query(sql("SELECT (SELECT count(*) FROM books) AS books, CAST(sum(l_quantity) AS DOUBLE) AS bytes FROM lineitem WHERE l_partkey IN (SELECT id FROM books)"))
def library_info(s: SparkSession, d: str) -> DataFrame:
    data = C.table(s, d, "lineitem").select(F.col("l_partkey").alias("book"), F.col("l_quantity").alias("uncompressed_size"))
    return remote.LocalBackend(C.books(s, d), data).info().withColumn("bytes", F.col("bytes").cast("double"))


@query(sql("SELECT id, title FROM books WHERE title ILIKE '%gear%' ORDER BY title, id LIMIT 50"))
def backend_list(s: SparkSession, d: str) -> DataFrame:
    return remote.backend("elsewhere", {"local": remote.LocalBackend(C.books(s, d))}).list_books("gear").select("id", "title")


# --- sets -------------------------------------------------------------------------------


@query("SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_linestatus = 'F'")
def set_intersect(s: SparkSession, d: str) -> DataFrame:
    l = C.table(s, d, "lineitem")  # noqa: E741
    return l.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("id")).intersect(l.filter("l_linestatus = 'F'").select("l_partkey"))


@query("SELECT p_partkey AS id FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def set_except(s: SparkSession, d: str) -> DataFrame:
    return C.table(s, d, "part").select(F.col("p_partkey").alias("id")).subtract(C.table(s, d, "lineitem").filter("l_quantity > 45").select("l_partkey"))


@query("SELECT name, kind FROM (SELECT 'A' AS name, 'user' AS kind UNION ALL SELECT 'B', 'found' UNION ALL SELECT 'C', 'user')")
def merged_sources(s: SparkSession, d: str) -> DataFrame:
    first = s.createDataFrame([("A", "found"), ("B", "found")], "name string, kind string")
    return C.merge_sources([first, s.createDataFrame([("A", "user"), ("C", "user")], "name string, kind string")])


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 1 THEN 'deleted' WHEN p_partkey % 10 = 2 THEN 'added' ELSE 'modified' END AS change FROM part WHERE p_partkey % 10 IN (1, 2, 3)")
def snapshot_changes(s: SparkSession, d: str) -> DataFrame:
    p = C.table(s, d, "part").select(F.col("p_partkey").alias("id"), "p_retailprice")
    new = p.filter("id % 10 <> 1").withColumn("p_retailprice", F.col("p_retailprice") + F.when(F.col("id") % 10 == 3, 1.0).otherwise(0.0))
    return R.snapshot_diff(p.filter("id % 10 <> 2"), new, "id", ["p_retailprice"])
