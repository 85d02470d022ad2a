"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Everything is a projection of the text. Places are found by splitting the text at a
pattern and adding up the lengths of pieces and matches. Candidates are runs of key
characters with a letter and a digit; each is classed by its alphabet (hex, alphanumeric,
base64), and a window slides over it: a step changes the counts of the character that
enters and of the one that leaves, and the two terms of the entropy sum that belong to
them. Strings that match the allow-list are passed over. Work grows with the text, a
little more than in proportion where one text has very many matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import native


def _either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key")
#: kind -> (pattern, group, least length of the group), in the order of ties.
BASE_KINDS = {
    "assign": (f"({_KEYWORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": ("AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": ("[0-9a-f]{24,}", 0, 24),
}
#: Runs of key characters with at least one letter and one digit.
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: class -> (pattern of the whole string, bits a character at which a window is secret).
CLASSES = {"hex": ("^[0-9a-fA-F]+$", 3.0), "alnum": ("^[0-9A-Za-z]+$", 3.5), "base64": ("", 3.6)}
#: Paths of words, and the same for the JVM, which would step back into pieces by recursion: no piece can be taken in two ways.
PATHS = "^/?([A-Za-z]{2,}[0-9]{0,2}[/_-])+[A-Za-z]{2,}[0-9]{0,4}$"
_PATHS_SEARCHED = "^/?(?:[A-Za-z]{2,}+[0-9]{0,2}+[/_-])++[A-Za-z]{2,}+[0-9]{0,4}+$"
#: Strings that are no secrets: UUIDs, placeholders and examples, dates and paths of words.
ALLOW = (
    "^[0-9A-Fa-f]{8}-([0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$",
    "EXAMPLE|[Ee]xample|[Pp]laceholder|[Xx]{6,}|0{8,}",
    "[0-9]{4}-[0-9]{2}-[0-9]{2}",
    PATHS,
)


def running_sums(sizes: Column) -> Column:
    """The sum of the items before each item, in blocks of about the square root of their number.

    Sums within a block and the sums of blocks are appended one by one, which copies what is
    there: of n items, each is copied about sqrt(n) times, so a text with 100,000 matches is no burden.
    """
    total = lambda x: F.aggregate(x, F.lit(0), lambda acc, v: acc + v)
    none = F.array().cast("array<int>")

    def before(x: Column, start: Column) -> Column:
        step = lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(x, F.struct(start.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def blocked(x: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(x))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / size).cast("int")), lambda i: F.slice(x, i * size + 1, size))
        return native.let(blocks, lambda own: F.flatten(F.zip_with(own, before(F.transform(own, total), F.lit(0)), before)))

    return native.let(sizes, lambda x: F.when(F.size(x) > 0, blocked(x)).otherwise(none))


def _matches(text: Column, pattern: str, least: int = 0, group: int = 0) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, in code points."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.slice(F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x)), F.lit(1), F.size(whole))
    pair = F.zip_with(whole, part, lambda w, p: F.struct(w.alias("w"), p.alias("p")))
    steps = F.zip_with(pair, gaps, lambda m, gap: F.struct(m["w"].alias("w"), m["p"].alias("p"), gap.alias("gap"), (gap + F.char_length(m["w"])).alias("step")))

    def placed(all_steps: Column) -> Column:
        ends = running_sums(F.transform(all_steps, lambda s: s["step"]))
        at = lambda s, before: F.struct(
            (before + s["gap"]).alias("start"), (before + s["step"]).alias("end"), s["w"].alias("value"), F.char_length(s["p"]).alias("size")
        )
        kept = F.filter(F.zip_with(all_steps, ends, at), lambda m: m["size"] >= least)
        return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))

    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), native.let(steps, placed)).otherwise(empty)


def max_window_entropy(value: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits a character, of a window of a string.

    A string shorter than the window is one window. Only the sum of n log n over the counts is
    carried: a step changes the terms of the character that enters and of the one that leaves,
    whose counts are those of the window that it makes.
    """
    size = F.least(F.char_length(value), F.lit(window))
    term = lambda n: F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))
    count = lambda own, c: F.char_length(own) - F.char_length(F.replace(own, c, F.lit("")))

    def step(acc: Column, i: Column) -> Column:
        # before the window is full, nothing leaves: the substring from below 1 is cut to the first i
        own = F.substr(value, F.greatest(i - window + 1, F.lit(1)), F.least(i, F.lit(window)))
        new, old = F.substr(value, i, F.lit(1)), F.when(i > window, F.substr(value, i - window, F.lit(1))).otherwise(F.lit(""))
        up, down = count(own, new), F.when(old != "", count(own, old)).otherwise(F.lit(0))
        change = F.when(new == old, F.lit(0.0)).otherwise(term(up) - term(up - 1) + F.when(old != "", term(down) - term(down + 1)).otherwise(F.lit(0.0)))
        total = acc["total"] + change
        full = F.when(i >= size, F.greatest(acc["best"], F.log2(size.cast("double")) - total / size)).otherwise(acc["best"])
        return F.struct(total.alias("total"), full.alias("best"))

    return F.aggregate(F.sequence(F.lit(1), F.char_length(value)), F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("best")), step, lambda acc: acc["best"])


def _secret(value: Column, allow: tuple[str, ...]) -> Column:
    """Whether a candidate has the entropy of a secret of its class."""
    limit = None
    for name, (pattern, bits) in CLASSES.items():
        limit = F.when(value.rlike(pattern), F.lit(bits)) if limit is None else (limit.when(value.rlike(pattern), F.lit(bits)) if pattern else limit.otherwise(F.lit(bits)))
    plain = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    for pattern in allow:
        plain = plain & ~value.rlike(_PATHS_SEARCHED if pattern == PATHS else pattern)
    return F.when(plain, F.round(max_window_entropy(value), 9) >= limit).otherwise(F.lit(False))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """One row for each row of ``docs``: the id, n_assign, n_access, n_hex, n_entropy, base_spans and spans.

    Spans are structs of (start, rank, end, kind), in code points, end exclusive, by start and
    then kind. Spans of the base kinds stay as they are; a high-entropy candidate adds one of
    kind ``entropy`` unless it overlaps a base span. A null text is empty. Ids are passed on
    as they are, null or repeated; an empty table gives no rows; whole texts are searched,
    however long. Other columns are not read.
    """
    df = docs.select(native.quoted(id_col).alias("_id"), F.coalesce(native.quoted(text_col), F.lit("")).alias("_text"))
    for kind, (pattern, group, least) in BASE_KINDS.items():
        df = df.withColumn(f"_{kind}", _matches(F.col("_text"), pattern, least, group))
    df = df.withColumn("_candidates", F.when(F.col("_text").rlike("[0-9]"), F.filter(_matches(F.col("_text"), CANDIDATE, 20), lambda m: _secret(m["value"], allow))))
    as_spans = lambda c, rank, kind: F.transform(c, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))
    base = F.sort_array(F.concat(*(as_spans(F.col(f"_{kind}"), k, kind) for k, kind in enumerate(BASE_KINDS))))
    df = df.withColumn("base_spans", base)
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    added = F.filter(F.coalesce("_candidates", none), lambda m: ~F.exists("base_spans", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    df = df.withColumn("_added", added)
    counts = {f"n_{kind}": F.size(f"_{kind}").cast("long") for kind in BASE_KINDS} | {"n_entropy": F.size("_added").cast("long")}
    spans = F.sort_array(F.concat("base_spans", as_spans(F.col("_added"), len(BASE_KINDS), "entropy")))
    return df.select(F.col("_id").alias(id_col), *(c.alias(k) for k, c in counts.items()), "base_spans", spans.alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _sql_found(column: str, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    total = "coalesce(list_sum(list_transform({x}, lambda y: length(y))), 0)"
    start = f"({total.format(x='pieces[1:i]')} + {total.format(x='m[1:i - 1]')})::BIGINT"
    return (
        f"{column} AS (SELECT doc_id, list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'s': {start}, 'v': m[i], 'p': g[i]}}), lambda x: length(x.p) >= {least}) AS {column}"
        f" FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS g, regexp_split_to_array(t, '{p}') AS pieces FROM texts))"
    )


def _sql_spans(column: str, rank: int, kind: str) -> str:
    return f"list_transform({column}, lambda x: {{'start': x.s, 'rank': {rank}, 'end': x.s + length(x.v), 'kind': '{kind}'}})"


def _sql_oracle() -> str:
    found = [_sql_found(kind, pattern, group, least) for kind, (pattern, group, least) in BASE_KINDS.items()] + [_sql_found("candidate", CANDIDATE, 0, 20)]
    entropy = f"list_max(list_transform(range(1, length(x.v) - {WINDOW - 2}), lambda k: list_aggregate(string_split(substr(x.v, k, {WINDOW}), ''), 'entropy')))"
    limit = " ".join(f"WHEN regexp_matches(x.v, '{p}') THEN {bits}" for p, bits in CLASSES.values() if p) + f" ELSE {CLASSES['base64'][1]}"
    secret = "regexp_matches(x.v, '[0-9]') AND regexp_matches(x.v, '[A-Za-z]')" + "".join(f" AND NOT regexp_matches(x.v, '{p}')" for p in ALLOW)
    apart = "len(list_filter(base, lambda b: b.start < x.s + length(x.v) AND x.s < b.\"end\")) = 0"
    base = " || ".join(_sql_spans(kind, k, kind) for k, kind in enumerate(BASE_KINDS))
    text = "array_to_string(list_transform({x}, lambda y: y.kind || ':' || y.start || ':' || y.\"end\"), ',')"
    joins = " ".join(f"JOIN {kind} ON {kind}.doc_id = texts.doc_id" for kind in (*BASE_KINDS, "candidate"))
    return (
        f"WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {', '.join(found)},"
        f" based AS (SELECT texts.doc_id, {', '.join(BASE_KINDS)}, candidate, list_sort({base}) AS base FROM texts {joins}),"
        f" added AS (SELECT *, list_filter(candidate, lambda x: {secret} AND {apart} AND round({entropy}, 9) >= CASE {limit} END) AS more FROM based)"
        f" SELECT doc_id, {', '.join(f'len({k})::BIGINT AS n_{k}' for k in BASE_KINDS)}, len(more)::BIGINT AS n_entropy, sha256({text.format(x='base')}) AS base_sha256,"
        f" {text.format(x='list_sort(base || ' + _sql_spans('more', len(BASE_KINDS), 'entropy') + ')')} AS spans FROM added"
    )


ORACLE_SQL = _sql_oracle()
