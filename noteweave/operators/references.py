"""References to records that do not exist.

A reference is a row whose key columns name a record of another table. Key
columns may be NULL in part; the match semantics say what that means:

simple   a reference with any NULL key column refers to nothing and is never
         an orphan (SQL MATCH SIMPLE)
partial  the non-NULL columns alone have to match (SQL MATCH PARTIAL)
full     all columns NULL refers to nothing; some NULL is always an orphan
         (SQL MATCH FULL)

or a table of its own says it mask by mask. Rows are grouped by their null
mask and each mask is anti-joined on its non-NULL columns. The time of a
reference may be the last column of the key; it matches a target that exists
by then.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteweave.functions.lookalike import not_plain_ascii, plain, plain_col
from noteweave.functions.text import fold, percent_decode
from noteweave.session import cut

#: What becomes of the references of a mask: matched on the columns that are there, orphans all, or no references.
MATCH, ORPHAN, NOTHING = "match", "orphan", "nothing"
Mask = tuple[bool, ...]


def semantics(match: str | dict[Mask, str], width: int) -> dict[Mask, str]:
    """What becomes of each null mask (True: the column is there) of a key of ``width`` columns."""
    if not isinstance(match, str):
        if missing := set(product((True, False), repeat=width)) - set(match):
            raise ValueError(f"no semantics for {sorted(missing)}")
        return match
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"unknown match semantics {match!r}")
    other = {"simple": NOTHING, "partial": MATCH, "full": ORPHAN}[match]
    return {m: MATCH if all(m) else other if any(m) else NOTHING for m in product((True, False), repeat=width)}


def masked(refs: DataFrame, key: list[str]) -> DataFrame:
    """``refs`` with ``__mask``, a character for each key column, 1 where it is there and 0 where it is NULL; written once."""
    return cut(refs.withColumn("__mask", F.concat(*[F.when(F.col(k).isNull(), "0").otherwise("1") for k in key])))


def orphans_of(
    marked: DataFrame,
    targets: DataFrame,
    keys: list[str],
    match: str | dict[Mask, str] = "simple",
    time: str | None = None,
    since: str | None = None,
) -> DataFrame:
    """The rows of ``marked`` (see ``masked``) whose key no row of ``targets`` serves.

    ``keys`` stand in both tables. With ``time`` (the last column of the key)
    and ``since`` (column of targets) a target serves a reference whose time
    is there only if since <= time; a target of NULL since then serves none.
    Targets with NULLs in the mask's columns serve nothing. Repeated rows stay
    repeated. Targets are reduced to one row per key (the earliest since)
    before the join, so a hot target key costs one row; a hot reference key is
    split by the adaptive skew join, for which the one target row is
    replicated. An empty table of targets leaves every reference an orphan.
    """
    columns = [*keys, time] if time else keys
    rules = semantics(match, len(columns))
    found = []
    for bits in sorted(r[0] for r in marked.select("__mask").distinct().collect()):  # at most 2^columns
        mask = tuple(c == "1" for c in bits)
        own = marked.filter(F.col("__mask") == bits).drop("__mask")
        if rules[mask] == ORPHAN:
            found.append(own)
        if rules[mask] != MATCH:
            continue
        on = [k for k, there in zip(columns, mask, strict=True) if there and k != time]
        timed = time is not None and mask[-1]
        named = targets.dropna(subset=[*on, *([since] if timed else [])])
        side = named.groupBy(*on).agg(F.min(since).alias("__since")) if timed else named.select(*on).distinct()
        side = side.select(*[F.col(k).alias(f"__{k}") for k in on], *(["__since"] if timed else []))
        same = [F.col(k) == F.col(f"__{k}") for k in on] + ([F.col("__since") <= F.col(time)] if timed else [])
        found.append(own.join(side, reduce(lambda x, y: x & y, same), "left_anti") if same else own.limit(0))
    return reduce(DataFrame.unionByName, found) if found else marked.drop("__mask").limit(0)


def orphans(refs: DataFrame, targets: DataFrame, keys: list[str], match: str | dict[Mask, str] = "simple", time: str | None = None, since: str | None = None) -> DataFrame:
    """The rows of ``refs`` whose key no row of ``targets`` serves: ``orphans_of`` the masked rows."""
    return orphans_of(masked(refs, [*keys, time] if time else keys), targets, keys, match, time, since)


def _meant(raw: Column) -> Column:
    """raw percent-decoded and in plain characters; Python only where needed."""

    def run(values):
        import pyarrow as pa

        return pa.array([None if v is None else plain(percent_decode(v)) for v in values.to_pylist()], pa.string())

    import pyarrow as pa

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    needs = raw.contains("%") | not_plain_ascii(raw)
    return F.when(needs, F.arrow_udf(run, "string")(F.when(needs, raw))).otherwise(raw)


def link_name(raw: Column) -> Column:
    """The name a link target means, or NULL where it is no reference to a note.

    Percent-decoded, cut at the first '#', trimmed, last path segment, without
    a final '.md' in any case, in plain characters, ASCII case folded.
    """
    meant = _meant(raw)
    cut = F.trim(F.substring_index(meant, "#", 1))
    name = F.element_at(F.split(cut, "/"), -1)
    name = F.regexp_replace(name, r"(?i)\.md$", "")
    no = (name == "") | meant.contains(":") | name.contains(".")
    return F.when(~no, fold(name))


def page_title(c: Column) -> Column:
    """A wiki title in one form: no anchor, blanks for underscores, runs of blanks
    as one, trimmed, first ASCII letter in upper case, plain characters; '' is NULL."""
    t = F.substring_index(plain_col(c), "#", 1)
    t = F.trim(F.regexp_replace(t, "[ _]+", " "))
    first = F.substring(t, 1, 1)
    t = F.concat(F.translate(first, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substring(t, 2, 1_000_000_000))
    return F.when(t != "", t)


def _hub_names(hubs: DataFrame) -> DataFrame:
    names = F.array_union(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))
    return hubs.select(F.explode(names).alias("name")).filter("name IS NOT NULL")


def link_references(links: DataFrame) -> DataFrame:
    """(tbl, row_id, name, at): the links that name a note, with the time seen."""
    return links.select(F.lit("links").alias("tbl"), F.col("link_id").cast("long").alias("row_id"), link_name(F.col("raw")).alias("name"), F.col("seen_at").alias("at"))


def note_targets(notes: DataFrame, aliases: DataFrame, hubs: DataFrame) -> DataFrame:
    """(name, since): names of living notes, their aliases and the hubs'.

    Hubs exist from the start of time.
    """
    real = notes.filter("alive AND NOT phantom").groupBy("note_key", "stem").agg(F.min("landed_at").alias("since"))
    by_key = real.groupBy("note_key").agg(F.min("since").alias("since"))
    alias = aliases.select("note_key", F.col("alias").alias("name")).distinct().join(by_key, "note_key").select("name", "since")
    stems = real.select(F.col("stem").alias("name"), "since")
    hub = _hub_names(hubs).select("name", F.lit("0001-01-01 00:00:00").cast("timestamp_ntz").cast(dict(notes.dtypes)["landed_at"]).alias("since"))
    every = stems.unionByName(alias).unionByName(hub)
    return every.select(fold(plain_col(F.col("name"))).alias("name"), "since").filter("name IS NOT NULL AND name <> ''")


def page_references(pages: DataFrame) -> DataFrame:
    """(tbl, row_id, name, at): the pages that lead to another page."""
    some = pages.filter("redirect IS NOT NULL AND redirect <> ''")
    return some.select(F.lit("wiki_pages").alias("tbl"), F.col("page_id").cast("long").alias("row_id"), page_title(F.col("redirect")).alias("name"), F.col("landed_at").alias("at"))


def page_targets(pages: DataFrame, hubs: DataFrame) -> DataFrame:
    """(name, since): living article titles and the hubs' names, in one form."""
    own = pages.filter("ns = '0' AND alive").select(F.col("title").alias("name"), F.col("landed_at").alias("since"))
    hub = _hub_names(hubs).select("name", F.lit("0001-01-01 00:00:00").cast("timestamp_ntz").cast(dict(pages.dtypes)["landed_at"]).alias("since"))
    return own.unionByName(hub).select(page_title(F.col("name")).alias("name"), "since").filter("name IS NOT NULL")


# The key is (name, time). Where the time is NULL the name alone has to match. A link without a name is no
# reference; a redirect of which no name is left leads nowhere and is an orphan.
LINK_MATCH = {(True, True): MATCH, (True, False): MATCH, (False, True): NOTHING, (False, False): NOTHING}
PAGE_MATCH = {(True, True): MATCH, (True, False): MATCH, (False, True): ORPHAN, (False, False): ORPHAN}
_KEY = ["name", "at"]


def _orphans(from_links: DataFrame, from_pages: DataFrame, notes: DataFrame, aliases: DataFrame, hubs: DataFrame, pages: DataFrame) -> DataFrame:
    lost = orphans_of(from_links, note_targets(notes, aliases, hubs), ["name"], LINK_MATCH, "at", "since")
    return lost.unionByName(orphans_of(from_pages, page_targets(pages, hubs), ["name"], PAGE_MATCH, "at", "since"))


def orphan_rows(links: DataFrame, pages: DataFrame, notes: DataFrame, aliases: DataFrame, hubs: DataFrame) -> DataFrame:
    """(tbl, row_id, at) of every orphan reference, repeated rows kept."""
    return _orphans(masked(link_references(links), _KEY), masked(page_references(pages), _KEY), notes, aliases, hubs, pages).select("tbl", "row_id", "at")


def _counted(refs: DataFrame, lost: DataFrame, by: str) -> DataFrame:
    n_refs = refs.groupBy("tbl", by).agg(F.count_distinct("row_id").alias("n_refs"))
    n_lost = lost.groupBy(F.col("tbl").alias("__t"), F.col(by).alias("__b")).agg(F.count_distinct("row_id").alias("n_orphans"))
    joined = n_refs.join(n_lost, (F.col("tbl") == F.col("__t")) & F.col(by).eqNullSafe(F.col("__b")), "left")
    return joined.select("tbl", by, "n_refs", F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"))


def orphan_report(links: DataFrame, pages: DataFrame, notes: DataFrame, aliases: DataFrame, hubs: DataFrame) -> DataFrame:
    """(tbl, month, n_refs, n_orphans): distinct rows per table and month."""
    from_links, from_pages = masked(link_references(links), _KEY), masked(page_references(pages), _KEY)
    month = F.date_format("at", "yyyy-MM").alias("month")
    refs = from_links.filter("name IS NOT NULL").unionByName(from_pages).select("tbl", "row_id", month)
    return _counted(refs, _orphans(from_links, from_pages, notes, aliases, hubs, pages).select("tbl", "row_id", month), "month")


def mask_report(links: DataFrame, pages: DataFrame, notes: DataFrame, aliases: DataFrame, hubs: DataFrame) -> DataFrame:
    """(tbl, mask, n_refs, n_orphans): distinct rows per table and null mask of (name, time), '10' a name without a time."""
    from_links, from_pages = masked(link_references(links), _KEY), masked(page_references(pages), _KEY)
    mask = F.concat(F.when(F.col("name").isNull(), "0").otherwise("1"), F.when(F.col("at").isNull(), "0").otherwise("1")).alias("mask")
    refs = from_links.unionByName(from_pages).select("tbl", "row_id", mask)
    return _counted(refs, _orphans(from_links, from_pages, notes, aliases, hubs, pages).select("tbl", "row_id", mask), "mask")
