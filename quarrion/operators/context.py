"""Context graphs from documents and code: sections, claims, symbols, search, resolution and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sections_and_claims(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, kind, level, text, section): markdown headings, and NOTE / WARNING / IMPORTANT lines in the section above them."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("line", "raw"))
    heading = F.regexp_extract("raw", r"^(#{1,6})\s+(.*?)\s*#*\s*$", 2)
    level = F.length(F.regexp_extract("raw", r"^(#{1,6})\s", 1))
    claim = F.regexp_extract("raw", r"^\s*(?:>\s*)?\**(NOTE|WARNING|IMPORTANT)\b", 1)
    kind = F.when((level > 0) & (heading != ""), "section").when(claim != "", F.lower(claim))
    marked = lines.withColumn("kind", kind).withColumn("level", level)
    above = F.last(F.when(F.col("kind") == "section", heading), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line"))
    return marked.withColumn("section", above).where("kind is not null").select("doc_id", "line", "kind", "level", F.when(F.col("kind") == "section", heading).otherwise(F.trim("raw")).alias("text"), "section")


# How declarations begin in the languages read.
SYMBOLS = {
    "python": r"^\s*(?:async\s+)?(def|class)\s+(\w+)",
    "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(fn|struct|enum|trait|mod|type|const|static|macro_rules!)\s+(\w+)",
    "go": r"^\s*(func|type)\s+(?:\([^)]*\)\s*)?(\w+)",
    "javascript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(function|class|const|let|interface|type|enum)\s+(\w+)",
}
EXTENSIONS = {"py": "python", "rs": "rust", "go": "go", "js": "javascript", "jsx": "javascript", "ts": "javascript", "tsx": "javascript"}


def language(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.(\w+)$", 1))
    out = F.lit(None).cast("string")
    for e, name in EXTENSIONS.items():
        out = F.when(extension == e, name).otherwise(out)
    return out


def symbols(sources: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, language, line, kind, name, is_test): declarations by their first line."""
    rows = sources.select(F.col(path_col).alias("path"), F.posexplode(F.split(text_col, "\n")).alias("line", "raw")).withColumn("language", language(F.col("path"))).where("language is not null")
    kind, name = F.lit(""), F.lit("")
    for lang, pattern in SYMBOLS.items():
        here = F.col("language") == lang
        kind = F.when(here, F.regexp_extract("raw", pattern, 1)).otherwise(kind)
        name = F.when(here, F.regexp_extract("raw", pattern, 2)).otherwise(name)
    found = rows.withColumn("kind", kind).withColumn("name", name).where("name <> ''")
    return found.select("path", "language", "line", "kind", "name", F.lower("name").startswith("test").alias("is_test"))


def calls(sources: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, caller, callee): names followed by a parenthesis, inside the declaration above them."""
    rows = sources.select(F.col(path_col).alias("path"), F.posexplode(F.split(text_col, "\n")).alias("line", "raw"))
    heads = symbols(sources, path_col, text_col).select("path", "line", "name")
    both = rows.join(heads, ["path", "line"], "left")
    caller = F.last("name", ignorenulls=True).over(Window.partitionBy("path").orderBy("line"))
    out = both.withColumn("caller", caller).where("name is null and caller is not null")
    callee = F.explode(F.regexp_extract_all("raw", F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1)))
    return out.select("path", "caller", callee.alias("callee")).where(~F.col("callee").isin("if", "for", "while", "switch", "match", "return", "catch"))


def lexical_search(entities: DataFrame, query: str, k: int, name_col: str = "label", extra: dict[str, float] | None = None, id_col: str = "entity_id") -> DataFrame:
    """(id, score): for each query term 10 for an equal label, else 4 for one that contains it; extra columns add their weight."""
    score = F.lit(0.0)
    for term in query.lower().split():
        label = F.lower(name_col)
        score = score + F.when(label == term, 10.0).when(F.contains(label, F.lit(term)), 4.0).otherwise(0.0)
        for column, weight in (extra or {}).items():
            score = score + F.when(F.contains(F.lower(column), F.lit(term)), float(weight)).otherwise(0.0)
    return entities.select(F.col(id_col).alias("id"), score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(k)


def seeded_query(symbols: DataFrame, edges: DataFrame, query: str, depth: int, seeds: int = 5) -> DataFrame:
    """(id, depth): the best symbols for a query, and what they lead to: all edges forwards, calls backwards as well.

    symbols (id, name, qualified, doc); edges (src, dst, type). A term gives 10 for an equal name, else 4 for one that holds it,
    2 for the qualified name and 1.5 for the description; ties go to the smaller id."""
    from .graph import reach

    score = F.lit(0.0)
    for term in [t for t in (w.strip("".join(c for c in w if not c.isalnum())) for w in query.lower().split()) if t]:
        holds = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(term)), F.lit(False))  # noqa: E731, B023
        score = score + F.when(F.lower("name") == term, 10.0).when(holds("name"), 4.0).otherwise(0.0) + F.when(holds("qualified"), 2.0).otherwise(0.0) + F.when(holds("doc"), 1.5).otherwise(0.0)
    best = symbols.select("id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(seeds).select("id")
    walk = edges.select("src", "dst", "type").unionByName(edges.where("type = 'CALLS'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type"))
    far = reach(walk, best.select(F.col("id").alias("start")), depth).select(F.col("node").alias("id"), "depth")
    return best.select("id", F.lit(0).alias("depth")).unionByName(far).groupBy("id").agg(F.min("depth").cast("long").alias("depth"))


def markdown_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(line): rows as lines of a markdown table, bars and line feeds escaped. The head is `markdown_head`."""
    cell = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |")).alias("line"))


def markdown_head(columns: list[str]) -> list[str]:
    return ["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]


def html_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(line): rows as <tr> elements with their texts escaped."""

    def cell(c: str) -> Column:
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        for a, b in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]:
            v = F.replace(v, F.lit(a), F.lit(b))
        return F.concat(F.lit("<td>"), v, F.lit("</td>"))

    return rows.select(F.concat(F.lit("<tr>"), *[cell(c) for c in columns], F.lit("</tr>")).alias("line"))


def resolve(references: DataFrame, entities: DataFrame) -> DataFrame:
    """(ref_id, state, confidence, targets): an exact label, else one that ends like the reference; one hit is resolved at 0.95, more are ambiguous at 0.5.

    references (ref_id, name), entities (entity_id, label). Suffixes meet by their last part, not by comparing all pairs.
    """
    exact = references.join(entities, references["name"] == entities["label"]).select("ref_id", "entity_id")
    rest = references.join(exact.select("ref_id"), "ref_id", "left_anti")
    part = lambda c: F.element_at(F.split(F.col(c), r"[./:]+"), -1)
    met = rest.withColumn("k", part("name")).join(entities.withColumn("k", part("label")), "k")
    ends = met.where(F.endswith("label", "name") | F.endswith("name", "label")).select("ref_id", "entity_id")
    hits = exact.unionByName(ends).groupBy("ref_id").agg(F.sort_array(F.collect_set("entity_id")).alias("targets"))
    out = references.select("ref_id").join(hits, "ref_id", "left").withColumn("targets", F.coalesce("targets", F.array().cast(hits.schema["targets"].dataType)))
    n = F.size("targets")
    return out.select("ref_id", F.when(n == 0, "unresolved").when(n == 1, "resolved").otherwise("ambiguous").alias("state"), F.when(n == 0, 0.0).when(n == 1, 0.95).otherwise(0.5).alias("confidence"), "targets")


def diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change): added, deleted, modified or unchanged between two snapshots."""
    pack = lambda d, n: d.select(key, F.struct(*fields).alias(n))
    both = pack(before, "_a").join(pack(after, "_b"), key, "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("modified")
    return both.select(key, change.alias("change"))


def manifest(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    return files.select(F.col(path_col).alias("path"), F.sha2(F.col(content_col).cast("binary"), 256).alias("hash"), F.length(content_col).cast("long").alias("bytes"))


def json_type(value: Column) -> Column:
    """Name of the JSON type of a text."""
    v = F.ltrim(value)
    first = F.substring(v, 1, 1)
    return F.when(value.isNull(), "null").when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(v.isin("true", "false"), "boolean").when(v == "null", "null").otherwise("number")


def json_keys(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, key, type, value): the top-level keys of JSON objects."""
    return rows.select(F.col(id_col).alias("id"), F.explode(F.from_json(json_col, "map<string,string>")).alias("key", "value")).select("id", "key", json_type(F.col("value")).alias("type"), "value")


def route(request: dict) -> str:
    """Strategy for a request by its fields and words."""
    text = str(request.get("query", "")).lower()
    if request.get("from") and request.get("to"):
        return "path"
    if request.get("entity") and any(w in text for w in ("impact", "break", "depends", "affect")):
        return "impact"
    if request.get("before") and request.get("after"):
        return "diff"
    if request.get("entity"):
        return "explore" if not request.get("depth") else "traverse"
    return "search"
