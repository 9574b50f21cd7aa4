"""URL filters: host and path rules, and a blocked Bloom filter of listed URLs before an exact hash join.

Only DataFrame functions. The filter is split into blocks of 512 bits: a URL's
hash picks a block and one bit in each of its eight 64-bit words, so a look-up
is an equi-join on the block's number and eight bit tests. What passes is
joined exactly with the list, which removes the filter's false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Odd multipliers, one for each word of a block: those of the Parquet format's split-block filter, widened by 2^32 + 1.
_SALTS = [0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31]


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host, path and query without scheme, `www.`, fragment, tracking parameters (utm_*, ref), `index.html` and closing slash; empty for null."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[^=]*|ref)(=|$)"))), "&")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/index\.html?$", "/"), "/+$", "")
    whole = F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.coalesce(whole, F.lit(""))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does. Rules: (`host/path`, allow or block).

    A rule fits its host and all its subdomains where the URL's path starts with its own.
    """
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _bits(url: Column) -> tuple[Column, list[Column]]:
    """A hash that picks the block, and the mask in each of the block's words."""
    second = F.xxhash64(url, F.lit("bits"))
    masks = []
    for s in _SALTS:
        odd = s * ((1 << 32) + 1) & ((1 << 63) - 1) | 1
        bit = F.shiftrightunsigned(F.xxhash64(second, F.lit(odd)), 58).cast("int")
        masks.append(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return F.xxhash64(url), masks


def bloom_blocks(listed: DataFrame, n_blocks: int, url: str = "canonical") -> DataFrame:
    """The filter as a table: block, w0 ... w7. It has n_blocks rows at most and is summed up before the shuffle."""
    h, masks = _bits(F.col(url))
    words = [F.bit_or(f"_m{i}").alias(f"w{i}") for i in range(8)]
    return listed.select(F.pmod(h, F.lit(n_blocks)).alias("block"), *[m.alias(f"_m{i}") for i, m in enumerate(masks)]).groupBy("block").agg(*words)


def passing(masks: list[Column]) -> Column:
    """Whether all bits of the masks are set in a block's words w0 ... w7; a block that is not there has none."""
    out = F.lit(True)
    for i, m in enumerate(masks):
        out = out & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(m) != 0)
    return out


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url", bits_per_url: int = 16) -> DataFrame:
    """key, host, path, rule, verdict, listed of every row of `pages`.

    `listed` has a column `url`; equal canonical URLs count once and empty
    ones never. The verdict is that of the longest rule that fits, else block
    if the URL is listed, else allow. Null URLs and those without `://` have
    an empty host and path and are allowed. Repeated rows are each judged;
    other columns of `pages` are left out; either table may be empty.
    """
    known = written(listed.select(canonical(F.col("url")).alias("canonical")).where("canonical <> ''").distinct(), "listed")
    n_blocks = max(1, -(-known.count() * bits_per_url // 512))
    blocks = written(bloom_blocks(known, n_blocks), "bloom")
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    seen = pages.select(key, host.alias("host"), path.alias("path"), canonical(F.col(url)).alias("canonical")).select("*", rule.alias("rule"), verdict.alias("_rule_verdict"))
    h, masks = _bits(F.col("canonical"))
    # the planner broadcasts both tables while their written size is under its limit, and shuffles beyond it
    # URLs without a canonical form are many and alike: each gets a block that the filter does not have
    block = F.when(F.col("canonical") == "", -1 - F.pmod(F.xxhash64(key), F.lit(1 << 30))).otherwise(F.pmod(h, F.lit(n_blocks)))
    probed = seen.withColumn("block", block).join(blocks, "block", "left")
    passes = passing(masks)
    hit = known.withColumnRenamed("canonical", "_known")
    # what the filter stops gets a key of its own, so that a shuffled join deals it evenly and it meets nothing
    own = F.when(passes, F.col("canonical")).otherwise(F.concat(F.lit("\n"), F.xxhash64(key, "canonical").cast("string")))
    judged = probed.withColumn("_key", own).join(hit, F.col("_key") == F.col("_known"), "left")
    is_listed = F.col("_known").isNotNull()
    return judged.select(key, "host", "path", "rule", F.coalesce("_rule_verdict", F.when(is_listed, "block").otherwise("allow")).alias("verdict"), is_listed.alias("listed"))
