"""Scalar text functions as column expressions: they stay inside the JVM and its generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4
SNIPPET_CHARS = 280
QUERY_CHARS = 500
MAX_TERM_BYTES = 40
BETWEEN_TERMS = r"[^\p{L}\p{N}]+"
#: The same for ASCII, which needs no pattern: what each byte becomes.
ASCII_SPACED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
PROMPT_BUDGET = 100_000


def strip(c: Column) -> Column:
    """Without white space at both ends, as Unicode has it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def content_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def raw_id(content_hash_: Column) -> Column:
    """The short id of a blob: ten hex digits of its hash."""
    return F.concat(F.lit("raw_"), F.substring(F.substring_index(content_hash_, ":", -1), 1, 10))


def is_url(c: Column) -> Column:
    return c.startswith("http://") | c.startswith("https://")


def frontmatter_end(c: Column) -> Column:
    """The place (from 1) of the line that closes the front matter, 0 if there is none."""
    return F.when(c.startswith("---\n"), F.locate("\n---\n", c, 4)).otherwise(F.lit(0))


def raw_body(c: Column) -> Column:
    end = frontmatter_end(c)
    return F.when(end > 0, F.substring(c, end + 5, F.length(c))).otherwise(c)


def raw_title(body: Column) -> Column:
    """The first level-one heading, empty if there is none; only \\n ends a line."""
    return strip(F.regexp_extract(body, r"(?md)^# (.*)$", 1))


def file_stem(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.when(name.rlike(r"^\.[^.]*$"), name).otherwise(F.regexp_replace(name, r"(.)\.[^.]*$", "$1"))


def wikilinks(body: Column) -> Column:
    """array<struct<pos,kind,vault,slug>> of the [[...]] links, in order."""
    inner = F.filter(F.regexp_extract_all(body, F.lit(r"(?s)\[\[(.*?)\]\]"), F.lit(1)), lambda x: (x != "") & ~x.contains("\n"))

    def parse(x: Column, i: Column) -> Column:
        target = F.substring_index(x, "|", 1)
        at = F.locate("::", target)
        return F.struct(
            i.alias("pos"),
            F.when(at > 0, F.lit("cross_vault")).otherwise(F.lit("local")).alias("kind"),
            F.when(at > 0, F.substring(target, F.lit(1), at - 1)).alias("vault"),
            F.when(at > 0, F.substring(target, at + 2, F.length(target))).otherwise(target).alias("slug"),
        )

    return F.transform(inner, parse)


def sections(body: Column) -> Column:
    """array<struct<heading,text>>: the text cut at lines that begin with '## ', without empty pieces; one empty piece if
    nothing is left. The piece before the first such line has no heading."""
    lines = F.regexp_replace(F.coalesce(body, F.lit("")), "\r\n", "\n")
    pieces = F.split(F.concat(F.lit("\n"), lines), "\n## ", -1)

    def cut(p: Column, i: Column) -> Column:
        head = strip(F.substring_index(p, "\n", 1))
        rest = F.when(F.locate("\n", p) > 0, F.substring(p, F.locate("\n", p) + 1, F.length(p))).otherwise(F.lit(""))
        return F.struct(F.when(i > 0, head).alias("heading"), strip(F.when(i > 0, rest).otherwise(p)).alias("text"))

    kept = F.filter(F.transform(pieces, cut), lambda s: s["text"] != "")
    none = F.array(F.struct(F.lit(None).cast("string").alias("heading"), F.lit("").alias("text")))
    return F.when(F.size(kept) > 0, kept).otherwise(none)


def snippet(text: Column) -> Column:
    return F.substring(text, 1, SNIPPET_CHARS)


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.char_length(text) / CHARS_PER_TOKEN).cast("long")


def prompt_tokens(active: Column, superseded: Column, related_tokens: Column) -> Column:
    """Estimated tokens of a prompt: the source, the version it replaces (if any) and the related pages."""
    return estimate_tokens(active) + F.coalesce(estimate_tokens(superseded), F.lit(0)) + F.coalesce(related_tokens, F.lit(0))


def truncate_to_budget(text: Column, budget: Column) -> Column:
    """At most four characters a token, with a note of how many were cut."""
    limit = (budget * CHARS_PER_TOKEN).cast("int")
    over = F.char_length(text) - limit
    note = F.concat(F.lit("\n\n[... truncated "), over.cast("string"), F.lit(" chars over budget ...]"))
    return F.when(over > 0, F.concat(F.substring(text, F.lit(1), limit), note)).otherwise(text)


def shared_budgets(active_tokens: Column, superseded_tokens: Column, budget: Column) -> Column:
    """struct<active,superseded>: what each may have of one budget. The smaller one keeps its size if it fits in a half."""
    half = F.floor(budget / 2).cast("long")
    pair = lambda a, s: F.struct(a.cast("long").alias("active"), s.cast("long").alias("superseded"))
    return (
        F.when(superseded_tokens.isNull(), pair(budget, F.lit(None)))
        .when(active_tokens + superseded_tokens <= budget, pair(active_tokens, superseded_tokens))
        .when(active_tokens <= half, pair(active_tokens, budget - active_tokens))
        .when(superseded_tokens <= half, pair(budget - superseded_tokens, superseded_tokens))
        .otherwise(pair(half, budget - half))
    )


def query_text(body: Column) -> Column:
    return F.substring(body, 1, QUERY_CHARS)


def terms(text: Column) -> Column:
    """Search terms: lower-cased runs of letters and digits, without those of 40 bytes or more."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN_TERMS), lambda t: (t != "") & (F.octet_length(t) < MAX_TERM_BYTES))


def spaced(text: Column) -> Column:
    """The same runs, of any length, with spaces between them once ASCII_SPACED is applied: one value to hand on, where terms would be thousands."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.regexp_replace(F.lower(text), r"[^\x00-\x7F\p{L}\p{N}]+", " "))


def strip_code_fence(text: Column) -> Column:
    t = strip(text)
    return strip(F.regexp_replace(F.regexp_replace(t, r"^```(?:json)?", ""), r"```$", ""))


def model_spec(spec: Column) -> Column:
    """struct<provider,model> of 'provider/model', null unless both are there."""
    at = F.locate("/", spec)
    return F.when((at > 1) & (at < F.length(spec)), F.struct(F.substring(spec, F.lit(1), at - 1).alias("provider"), F.substring(spec, at + 1, F.length(spec)).alias("model")))


def env_name(name: Column) -> Column:
    return F.regexp_replace(F.upper(name), "[^A-Z0-9]", "_")


def base_url(url: Column) -> Column:
    whole = F.when(is_url(url), url).otherwise(F.concat(F.lit("http://"), url))
    return F.when(whole.endswith("/"), whole).otherwise(F.concat(whole, F.lit("/")))


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def inside_vault(path: Column) -> Column:
    """Whether a relative path never climbs above its root, nor is absolute."""
    step = lambda p: F.when(p == "..", F.lit(-1)).when(p.isin("", "."), F.lit(0)).otherwise(F.lit(1))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))

    def walk(acc: Column, p: Column) -> Column:
        depth = acc["depth"] + step(p)
        return F.struct(depth.alias("depth"), F.least(acc["least"], depth).alias("least"))

    return ~path.startswith("/") & (F.aggregate(F.split(path, "/"), start, walk)["least"] >= 0)


def normal_path(path: Column) -> Column:
    """The path without empty and . steps, each .. taken together with the step before it; of paths inside the vault only."""
    step = lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(p)))
    return F.when(inside_vault(path), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def writable(path: Column) -> Column:
    """Whether a page can be written there: inside the vault, and not the vault's own folder."""
    return inside_vault(path) & (normal_path(path) != "")


#: A key that holds one of these, in any case, is sensitive.
SENSITIVE = ("password", "token", "secret", "authorization", "apikey", "api_key", "api-key", "credential")


def is_sensitive(key: Column) -> Column:
    return F.lower(key).rlike("|".join(SENSITIVE))
