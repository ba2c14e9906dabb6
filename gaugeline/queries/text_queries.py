"""Text rules over whole documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.functions import text as rules
from gaugeline.functions.sanitize import nonfinite_to_null
from gaugeline.plans import publication, reconcile
from gaugeline.queries.registry import Tables, query

NOISY_TEXT = (
    "CASE WHEN doc_id % 3 = 0 THEN '  ​' || text || ' \t x\u0007y  ' "
    "WHEN doc_id % 3 = 1 THEN text || '­' ELSE text END"
)


@query(
    "clean_text",
    "SELECT doc_id, trim(regexp_replace(regexp_replace(raw, '\\p{C}', ' ', 'g'), '[\\s\\p{Z}]+', ' ', 'g')) AS cleaned, "
    "length(trim(regexp_replace(regexp_replace(raw, '\\p{C}', ' ', 'g'), '[\\s\\p{Z}]+', ' ', 'g'))) <= 300 AS accepted "
    f"FROM (SELECT doc_id, {NOISY_TEXT} AS raw FROM documents) d",
)
def clean_text(t: Tables) -> DataFrame:
    raw = t.documents.selectExpr("doc_id", f"{NOISY_TEXT} AS raw")
    return raw.select(
        "doc_id", rules.cleaned(F.col("raw")).alias("cleaned"),
        rules.reason_accepted(F.col("raw")).alias("accepted"),
    )


LEAKY_TEXT = (
    "CASE WHEN conv_id % 5 = 0 THEN text || ' Authorization: bearer abc.DEF-123 done' "
    "WHEN conv_id % 5 = 1 THEN 'key sk-abcdefgh12345678 ' || text "
    "WHEN conv_id % 5 = 2 THEN text || ' see C:/Users/me/notes.txt' "
    "WHEN conv_id % 5 = 3 THEN 'org_Abc123 gsk_ABCDEFGH0123456789abcdef ' || text ELSE text END"
)


@query(
    "redact_text",
    "SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, "
    "'\\b(?:gsk_|sk-)[A-Za-z0-9_-]{8,}', '[redacted credential]', 'g'), "
    "'(?i)Bearer\\s+[A-Za-z0-9_.-]+', 'Bearer [redacted]', 'g'), "
    "'(^|[^A-Za-z0-9])[A-Za-z]:[\\\\/][^\\r\\n\"'']+', '\\1[local path]', 'g'), "
    "'\\borg_[A-Za-z0-9]+', '[provider organization]', 'g') AS redacted "
    f"FROM (SELECT conv_id, turn, {LEAKY_TEXT} AS raw FROM conversations) c",
)
def redact_text(t: Tables) -> DataFrame:
    raw = t.conversations.selectExpr("conv_id", "turn", f"{LEAKY_TEXT} AS raw")
    return raw.select("conv_id", "turn", rules.redacted(F.col("raw"), limit=None).alias("redacted"))


@query(
    "credential_scan",
    "SELECT role, count(*) AS n, count(*) FILTER (WHERE "
    "regexp_matches(raw, '\\bgsk_[A-Za-z0-9]{20,}|\\bsk-(?:proj-)?[A-Za-z0-9_-]{30,}')) AS hits "
    f"FROM (SELECT role, {LEAKY_TEXT} AS raw FROM conversations) c GROUP BY role",
)
def credential_scan(t: Tables) -> DataFrame:
    raw = t.conversations.selectExpr("role", f"{LEAKY_TEXT} AS raw")
    return raw.groupBy("role").agg(
        F.count("*").alias("n"), F.count_if(rules.has_credential(F.col("raw"))).alias("hits")
    )


@query(
    "credential_documents",
    "SELECT doc_id, lang FROM documents WHERE regexp_matches(text, "
    "'\\bgsk_[A-Za-z0-9]{20,}|\\bsk-(?:proj-)?[A-Za-z0-9_-]{30,}')",
)
def credential_documents(t: Tables) -> DataFrame:
    return t.documents.filter(rules.has_credential(F.col("text"))).select("doc_id", "lang")


@query(
    "line_feed_digests",
    "SELECT doc_id, sha256(replace(raw, '\r\n', '\n')) AS sha256 FROM "
    "(SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, '\n', '\r\n') ELSE text END AS raw FROM documents) d",
)
def line_feed_digests(t: Tables) -> DataFrame:
    raw = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(
        F.col("text")
    )
    return t.documents.select("doc_id", rules.normalized_digest(raw).alias("sha256"))


@query("number_literals")
def number_literals(t: Tables) -> DataFrame:
    """Numeric literals of every document, by value (needs look-around, which RE2 lacks)."""
    listed = t.documents.select("doc_id", F.explode(rules.number_texts(F.col("text"))).alias("literal"))
    return listed.select("doc_id", "literal", rules.number_key(F.col("literal")).alias("number"))


BOLD_TEXT = (
    "CASE WHEN conv_id % 6 = 0 THEN text || ' The table is fully clean.' "
    "WHEN conv_id % 6 = 1 THEN text || '. It is not fully balanced.' "
    "WHEN conv_id % 6 = 2 THEN text || '. This is not ideal, but completely valid' "
    "WHEN conv_id % 6 = 3 THEN text || '. There is no guarantee of 1.5 and no leakage; ok' "
    "WHEN conv_id % 6 = 4 THEN text || '. We cannot say more. No data-quality issues' ELSE text END"
)
_PROMISE = (
    "(?i)\\b(?:100(?:\\.0+)?\\s*%|fully|completely|perfectly|entirely)\\s+(?:clean|balanced|safe|valid)\\b"
    "|(?i)\\b(?:no|without any)\\s+(?:data[- ]quality (?:issues|problems)|leakage)\\b"
)
_DENIAL = "(?i)\\b(?:not|cannot|can''t|doesn''t|does not|no guarantee)\\b"


@query(
    "unsupported_assurance",
    "SELECT conv_id, turn, list_bool_or(list_transform(string_split_regex("
    "regexp_replace(raw, '\\.(\\d)', '\u00b7\\1', 'g'), "
    "'[!?;\\n]|\\.|(?i)\\b(?:but|however|yet)\\b|,\\s*(?i)and\\b'), "
    f"lambda c: regexp_matches(c, '{_PROMISE}') AND NOT regexp_matches("
    f"regexp_replace(c, '(?s)(?:{_PROMISE}).*$', ''), '{_DENIAL}'))) AS unsupported "
    f"FROM (SELECT conv_id, turn, {BOLD_TEXT} AS raw FROM conversations) c",
)
def unsupported_assurance(t: Tables) -> DataFrame:
    raw = t.conversations.selectExpr("conv_id", "turn", f"{BOLD_TEXT} AS raw")
    return raw.select(
        "conv_id", "turn", rules.unsupported_assurance(F.col("raw")).alias("unsupported")
    )


@query(
    "header_facts",
    "SELECT p_partkey, lower(n) AS folded, strlen(n) AS bytes, trim(n) = '' AS blank, "
    "starts_with(n, 'Unnamed:') AS unnamed, strlen(n) > 256 AS too_long FROM (SELECT p_partkey, "
    "CASE WHEN p_partkey % 9 = 0 THEN 'Unnamed: ' || p_partkey WHEN p_partkey % 9 = 1 THEN '  ' "
    "WHEN p_partkey % 9 = 2 THEN repeat(p_name || 'é', 40) ELSE upper(p_name) END AS n FROM part) p",
)
def header_facts(t: Tables) -> DataFrame:
    named = t.part.selectExpr(
        "p_partkey",
        "CASE WHEN p_partkey % 9 = 0 THEN 'Unnamed: ' || p_partkey WHEN p_partkey % 9 = 1 THEN '  ' "
        "WHEN p_partkey % 9 = 2 THEN repeat(p_name || 'é', 40) ELSE upper(p_name) END AS n",
    )
    return named.select("p_partkey", rules.header_facts(F.col("n")).alias("f")).select("p_partkey", "f.*")


@query(
    "nonfinite_sanitized",
    "SELECT event_id, CASE WHEN isfinite(v) THEN v END AS v, CASE WHEN isfinite(v) THEN v END AS inner_v, "
    "CASE WHEN v IS NULL OR isfinite(v) THEN 0 ELSE 3 END AS replaced FROM (SELECT event_id, "
    "CASE WHEN event_id % 97 = 0 THEN 'inf'::DOUBLE WHEN event_id % 53 = 0 THEN 'nan'::DOUBLE ELSE value END AS v "
    "FROM events) e",
)
def nonfinite_sanitized(t: Tables) -> DataFrame:
    raw = t.events.selectExpr(
        "event_id",
        "CASE WHEN event_id % 97 = 0 THEN CAST('inf' AS DOUBLE) WHEN event_id % 53 = 0 THEN CAST('nan' AS DOUBLE) "
        "ELSE value END AS v",
    )
    nested = raw.withColumn("s", F.struct("v", F.array("v", F.lit(1.0)).alias("items")))
    clean = nonfinite_to_null(nested, "replaced")
    return clean.select("event_id", "v", F.col("s.v").alias("inner_v"), "replaced")


@query(
    "repeat_numbers",
    "SELECT user_id, CAST(nullif(regexp_extract(run_id, '_r(\\d+)_\\d+$', 1), '') AS INTEGER) AS repeat, count(*) AS n "
    "FROM (SELECT user_id, CASE WHEN event_id % 10 = 0 THEN event_type || event_id ELSE event_type || '_r' || (event_id % 4) || '_' || event_id END AS run_id "
    "FROM events) e GROUP BY 1, 2",
)
def repeat_numbers(t: Tables) -> DataFrame:
    runs = t.events.selectExpr(
        "user_id",
        "CASE WHEN event_id % 10 = 0 THEN event_type || event_id ELSE event_type || '_r' || (event_id % 4) || '_' || event_id END AS run_id",
    )
    return runs.groupBy("user_id", rules.repeat_number(F.col("run_id")).alias("repeat")).agg(
        F.count("*").alias("n")
    )


# -- set operations and joins on text --------------------------------------------------------


@query(
    "ordered_distinct",
    "SELECT conv_id, string_agg(role, ',' ORDER BY first_position) AS roles FROM "
    "(SELECT conv_id, role, min(turn) AS first_position FROM conversations GROUP BY conv_id, role) r GROUP BY conv_id",
)
def ordered_distinct(t: Tables) -> DataFrame:
    firsts = reconcile.first_positions(t.conversations, ["conv_id"], "role", "turn")
    ordered = F.array_sort(F.collect_list(F.struct("first_position", "role")))
    return firsts.groupBy("conv_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["role"]), ",").alias("roles")
    )


@query(
    "group_set_difference",
    "SELECT key, only_in FROM (SELECT key, 'left' AS only_in FROM (SELECT user_id AS key FROM events EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey <> 3) a "
    "UNION ALL SELECT key, 'right' FROM (SELECT c_custkey AS key FROM customer WHERE c_nationkey <> 3 EXCEPT SELECT user_id FROM events) b) u",
)
def group_set_difference(t: Tables) -> DataFrame:
    return reconcile.group_set_difference(
        t.events.select(F.col("user_id").alias("key")),
        t.customer.filter("c_nationkey <> 3").select(F.col("c_custkey").alias("key")),
    )


_HREF = 'href="([^"]+)"'


@query(
    "dangling_links",
    "WITH l AS (SELECT DISTINCT page_id, regexp_replace(d, '#.*$', '') AS target FROM "
    f"(SELECT page_id, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS d FROM pages) x) "
    "SELECT page_id, target FROM l WHERE target <> '' AND NOT starts_with(target, 'mailto:') "
    "AND target NOT IN (SELECT regexp_replace(url, '#.*$', '') FROM pages)",
)
def dangling_links(t: Tables) -> DataFrame:
    links = publication.link_targets(F.col("html"), _HREF)
    known = t.pages.select(F.regexp_replace("url", "#.*$", "").alias("target"))
    return publication.dangling_links(t.pages, "page_id", links, known)


@query(
    "markdown_links",
    "SELECT page_id, target, regexp_matches(target, '^[a-zA-Z]+://') AS external FROM "
    "(SELECT DISTINCT page_id, regexp_replace(d, '#.*$', '') AS target FROM (SELECT page_id, "
    "unnest(regexp_extract_all('[a](' || url || ') [b](docs/p' || page_id || '.md#x) [c](mailto:me) [d](#top)', '\\]\\(([^)]+)\\)', 1)) AS d FROM pages) x) y "
    "WHERE target <> '' AND NOT starts_with(target, 'mailto:')",
)
def markdown_links(t: Tables) -> DataFrame:
    written = F.concat(
        F.lit("[a]("), "url", F.lit(") [b](docs/p"), F.col("page_id").cast("string"),
        F.lit(".md#x) [c](mailto:me) [d](#top)"),
    )
    listed = t.pages.select("page_id", F.explode(publication.link_targets(written)).alias("target"))
    return listed.withColumn("external", publication.is_external(F.col("target")))


@query(
    "known_secret_hits",
    "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
)
def known_secret_hits(t: Tables) -> DataFrame:
    """Which documents hold which known text, all texts in one pass."""
    return publication.known_secret_hits(t.documents, "doc_id", "text", t.benchmark, "item_id", "text")


# links of a page to the page before it, written in six ways
_LINK_KINDS = (
    "./p{t}.md", "../docs/x/../p{t}.md#part", "/docs/p{t}.md", "../../p{t}.md", "https://example.com/p{t}.md", "p{t}%2Emd",
)


def _link_sql() -> str:
    cases = []
    for k, form in enumerate(_LINK_KINDS):
        shown = form.partition("#")[0].replace("%2E", ".")
        before, after = shown.split("{t}")
        cases.append((k, f"'{before}' || t || '{after}'"))
    target = "CASE k " + " ".join(f"WHEN {k} THEN {v}" for k, v in cases) + " END"
    return (
        f"SELECT 'docs/p' || page_id || '.md' AS page, {target} AS target, CASE WHEN k = 3 THEN '../p' || t || '.md' ELSE 'docs/p' || t || '.md' END AS path, "
        "CASE WHEN k = 3 OR NOT EXISTS (SELECT 1 FROM pages q WHERE q.page_id = t AND t % 5 <> 0) THEN 'missing' ELSE 'untracked' END AS status "
        "FROM (SELECT page_id, page_id % 6 AS k, page_id - 1 AS t FROM pages) l WHERE k <> 4 AND (k = 3 OR t % 3 = 0 OR "
        "NOT EXISTS (SELECT 1 FROM pages q WHERE q.page_id = t AND t % 5 <> 0))"
    )


@query("link_problems", _link_sql())
def link_problems(t: Tables) -> DataFrame:
    """Links resolved against their page: missing (a fifth of the files), untracked (a third) or out of the tree."""
    form = F.array(*[F.lit(f) for f in _LINK_KINDS])[(F.col("page_id") % 6).cast("int")]
    target = F.replace(form, F.lit("{t}"), (F.col("page_id") - 1).cast("string"))
    path = F.concat(F.lit("docs/p"), F.col("page_id").cast("string"), F.lit(".md"))
    pages = t.pages.select(path.alias("page"), F.concat(F.lit("See [it]("), target, F.lit(") and [top](#top).")).alias("text"))
    known = t.pages.filter("page_id % 5 <> 0").select(path.alias("path"), (F.col("page_id") % 3 != 0).alias("tracked"))
    return publication.link_problems(pages, "page", publication.link_targets(F.col("text")), known)


_PATHS = (
    "CASE WHEN page_id % 6 = 0 THEN '.venv/lib/x.py' WHEN page_id % 6 = 1 THEN 'src/tmp/a.md' "
    "WHEN page_id % 6 = 2 THEN 'data/benchmarks/a.csv' WHEN page_id % 6 = 3 THEN 'docs/~$draft.docx' "
    "WHEN page_id % 6 = 4 THEN '.env' ELSE 'docs/' || page_id || '.md' END"
)


@query(
    "forbidden_paths",
    "SELECT page_id, path FROM (SELECT page_id, "
    f"{_PATHS} AS path FROM pages) p WHERE list_has_any(string_split(path, '/'), ['.venv', 'tmp', '__pycache__', '.pytest_cache']) "
    "OR starts_with(string_split(path, '/')[-1], '~$') OR path IN ('.env', '.streamlit/secrets.toml') OR starts_with(path, 'data/benchmarks/')",
)
def forbidden_paths(t: Tables) -> DataFrame:
    listed = t.pages.selectExpr("page_id", f"{_PATHS} AS path")
    return listed.filter(rules.forbidden_path(F.col("path")))
