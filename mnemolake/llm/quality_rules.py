"""Quality rules as a bitmask ledger.

``rule_ledger`` evaluates every rule once for each document and stores the measurements
and one long of failure bits. Policies are versioned masks over these bits, so a verdict,
another policy's verdict and the ablation of every rule need the bits only: no text is
read again. Everything is a projection but the ablation, which first counts documents for
each distinct bitmask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import native

#: Bit of each rule: (name, condition on the measurements under which a document fails).
RULES: tuple[tuple[str, str], ...] = (
    ("too_few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("too_many_words", "n_words > 1000000"),
    ("mean_word_short", "word_chars < 2 * n_words"),
    ("mean_word_long", "word_chars > 12 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_text_lines"),
    ("upper_case", "10 * n_upper > 5 * n_letters"),
    ("exclamations", "10 * n_exclamations > 3 * n_words"),
    ("few_letters", "2 * n_letters < word_chars"),
    ("replacement_chars", "100 * n_replacement > word_chars"),
    ("bullet_lines", "10 * n_bullet_lines > 9 * n_text_lines AND n_text_lines > 3"),
    ("ellipsis_lines", "10 * n_ellipsis_lines > 3 * n_text_lines AND n_text_lines > 3"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
#: The two rules that every policy holds.
BASE = BIT["too_few_words"] | BIT["repeated_windows"]
ALL = (1 << len(RULES)) - 1
#: Versioned policies: rules whose failure rejects a document.
POLICIES: dict[str, int] = {
    "base-1": BASE,
    "strict-1": ALL,
    "standard-1": ALL & ~(BIT["ellipsis_lines"] | BIT["bullet_lines"]),
}
DEFAULT_POLICY = "standard-1"
WINDOW = 8


def _repeat_words(hashes: Column, n: int) -> Column:
    """Positions covered by windows of n that occur twice or more; hashes: one for each window."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    neighbours = lambda s: F.zip_with(s, native.shifted(s, 1), same)
    either = lambda after, before: F.coalesce(after, F.lit(False)) | F.coalesce(before, F.lit(False))
    found = lambda same_next: F.zip_with(same_next, F.concat(F.array(F.lit(False)), same_next), either)
    marked = lambda s: F.zip_with(s, native.let(neighbours(s), found), lambda x, f: F.when(f, x["i"]))
    places = F.sort_array(F.filter(native.let(ordered, marked), lambda i: i.isNotNull()))
    return F.aggregate(
        places,
        F.struct(F.lit(-n).alias("last"), F.lit(0).cast("long").alias("total")),
        lambda acc, i: F.struct(i.alias("last"), (acc["total"] + F.least(F.lit(n), i - acc["last"])).alias("total")),
        lambda acc: acc["total"],
    )


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with the measurements of the rules as further columns."""
    text = F.coalesce(native.quoted(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(native.WORD))
    df = docs.withColumns({"_w": native.words(text), "_lines": lines, "_text": text})
    df = df.withColumn("_h1", F.transform("_w", lambda w: F.xxhash64(w)))
    for k in (1, 2, 4):
        df = df.withColumn(f"_h{2 * k}", native.joined_hashes(F.col(f"_h{k}"), native.shifted(F.col(f"_h{k}"), k)))
    count = lambda pattern: F.regexp_count("_text", F.lit(pattern)).cast("long")
    starting = lambda pattern: F.size(F.filter("_lines", lambda line: line.rlike(pattern))).cast("long")
    return df.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.char_length(F.array_join("_w", "")).cast("long"),
            "n_symbols": count("[#*$%&|<>]"),
            "n_text_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.when(F.size(F.array_distinct("_h8")) == F.size("_h8"), F.lit(0).cast("long")).otherwise(_repeat_words(F.col("_h8"), WINDOW)),
            "n_letters": count("\\p{L}"),
            "n_upper": count("\\p{Lu}"),
            "n_exclamations": count("!+"),
            "n_replacement": count("\\x{FFFD}"),
            "n_bullet_lines": starting("^[\\x20\\x09]*[-*\\u2022]"),
            "n_ellipsis_lines": starting("(\\.\\.\\.|\\u2026)[\\x20\\x09\\x0D]*$"),
        }
    ).drop("_w", "_lines", "_text", "_h1", "_h2", "_h4", "_h8")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_text_lines", "n_letters", "n_upper", "n_exclamations", "n_replacement", "n_bullet_lines", "n_ellipsis_lines")


def rule_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the id, the measurements, and ``fail_bits``.

    A null or empty text has no words, lines or symbols: every measurement is 0, and it fails
    ``too_few_words``. Ids are passed on as they are, null or repeated. Windows are compared
    by 64-bit hashes within one text. A very long text is measured whole, in one row, with work
    in proportion to its words, sorting aside. An empty table gives no rows. Other columns are
    not read.
    """
    measured = measure(docs.select(native.quoted(id_col).alias("_id"), native.quoted(text_col).alias("_source")), "_source")
    bits = None
    for name, failing in RULES:
        bit = F.when(F.expr(failing), F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long"))
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measured.select(F.col("_id").alias(id_col), *MEASURES, bits.alias("fail_bits"))


def apply_policy(ledger: DataFrame, policy: str | int = DEFAULT_POLICY) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept``: no rule of the policy, and no base rule, failed."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    failed = lambda m: F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")) != 0
    return ledger.withColumns({"base_failed": failed(BASE), "kept": ~failed(mask | BASE)})


def ablations(ledger: DataFrame, policy: str | int = DEFAULT_POLICY) -> DataFrame:
    """For each rule of the policy: documents that fail it, fail it alone, and are kept without it.

    Documents are first counted for each bitmask, of which there are at most 2 ** len(RULES).
    """
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    masks = ledger.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    sums = []
    for name, _ in RULES:
        bit = F.lit(BIT[name] & mask).cast("long")
        hit = F.col("bits").bitwiseAND(bit) != 0
        alone = hit & (F.col("bits") == bit)
        without = F.col("bits").bitwiseAND(F.bitwise_not(bit)) == 0
        each = [F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)) for c in (hit, alone, without)]
        sums.append(F.struct(F.lit(name).alias("rule"), *(x.alias(k) for x, k in zip(each, ("n_failed", "n_failed_alone", "n_kept_without")))))
    return masks.agg(F.array(*sums).alias("rows")).select(F.inline("rows"))


def _sql_bits(mask: int) -> str:
    return " + ".join(f"(CASE WHEN {failing} THEN {BIT[name] & mask} ELSE 0 END)" for name, failing in RULES)


_LINES_LIKE = "len(list_filter(ls, lambda l: regexp_matches(l, '{p}')))::BIGINT"
_COUNT = "len(regexp_extract_all(t, '{p}'))::BIGINT"
ORACLE_SQL = f"""
WITH worded AS (
  SELECT doc_id, t, regexp_extract_all(t, '{native.WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{native.WORD}')) AS ls
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
), windows AS (
  SELECT doc_id, i, list_slice(ws, i, i + {WINDOW - 1}) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM worded)
), covered AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (
    SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1)
  GROUP BY doc_id
), measured AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, {_COUNT.format(p="[#*$%&|<>]")} AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(ls)::BIGINT AS n_text_lines,
    {_COUNT.format(p=chr(92) + "p{L}")} AS n_letters, {_COUNT.format(p=chr(92) + "p{Lu}")} AS n_upper, {_COUNT.format(p="!+")} AS n_exclamations,
    {_COUNT.format(p=chr(92) + "x{FFFD}")} AS n_replacement, {_LINES_LIKE.format(p="^[" + chr(92) + "x20" + chr(92) + "x09]*[-*" + chr(0x2022) + "]")} AS n_bullet_lines,
    {_LINES_LIKE.format(p="(" + chr(92) + "." + chr(92) + "." + chr(92) + ".|" + chr(0x2026) + ")[" + chr(92) + "x20" + chr(92) + "x09" + chr(92) + "x0D]*$")} AS n_ellipsis_lines
  FROM worded w LEFT JOIN covered c ON w.doc_id = c.doc_id
), judged AS (SELECT *, ({_sql_bits(ALL)})::BIGINT AS fail_bits FROM measured)
SELECT *, (fail_bits & {BASE}) <> 0 AS base_failed, (fail_bits & {POLICIES[DEFAULT_POLICY] | BASE}) = 0 AS kept FROM judged
"""
