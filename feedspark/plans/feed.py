"""The end-to-end feed plan over the test tables; stage tables are written when first asked for.

events -> key schedule -> control replies -> rotation fold -> key epochs
events -> wire (encoded, damaged) -> as-of keys -> gate/decode -> parse -> packets
packets -> gaps -> batches -> requests -> archive replies -> recovered -> feed
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspark.operators import keys as K
from feedspark.operators import loss as L
from feedspark.operators import packets as P
from feedspark.operators import recovery as R
from feedspark.operators.scan import scan
from feedspark import constants as C
from feedspark.sources import writer as W
from feedspark.session import materialize
from feedspark.sources.tables import events_as_feed, read_table

# ---- fixed values of the test fixture ----------------------------------------
ARCHIVE_SKIPS_EVERY = 5      # the archive lacks numbers with seq % 5 = 0 in the first round,
ARCHIVE_NEVER_HAS = 5        # and only those with seq % 10 = 5 from the second round on
FAILS_FIRST, FAILS_TWICE = 7, 49   # it answers a request from lo with an error at lo % 7 = 6, and again at lo % 49 = 48
# ------------------------------------------------------------------------------


def archive_replies(requests: DataFrame, archive: DataFrame) -> DataFrame:
    """The fixture's archive: one reply body per request, lines ``number^message`` in number order, or an error text.

    A request fails at its first attempt if ``lo % 7 = 6``, and at its second
    if ``lo % 49 = 48``.  The parts of all requests are disjoint per date; a row
    of the archive belongs to the last part that starts at or before its number,
    if that reaches it, so no lost number is written out to be looked up.
    """
    date, key = ["channel", "feed_date"], ["channel", "feed_date", "lo", "hi"]
    asked = F.struct("lo", "hi", "attempts", F.col("p.hi").alias("until"))
    starts = requests.select("*", F.explode("parts").alias("p")).select(
        *date, F.col("p.lo").alias("at"), F.lit(0).alias("kind"), asked.alias("asked"))
    stock = archive.where("channel is not null and feed_date is not null and seq is not null and message is not null")
    stock = stock.select(*date, F.col("seq").alias("at"), F.lit(1).alias("kind"), "message")
    found = scan(starts.unionByName(stock, allowMissingColumns=True), date, ["at", "kind"], carry=F.col("asked"))
    found = found.where((F.col("kind") == 0) | (F.col("at") <= F.col("carried.until"))).select(
        *date, "carried.lo", "carried.hi", "carried.attempts", F.col("at").alias("seq"), "message")
    line = F.when(F.col("message").isNotNull(), F.struct("seq", F.concat_ws("^", F.col("seq").cast("string"), "message").alias("t")))
    g = found.groupBy(*key, "attempts").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    body = F.concat(F.lit(C.REPLY_HEADER + "\n"), F.array_join(F.transform("lines", lambda x: x["t"]), "\n"))
    fails = ((F.col("attempts") == 1) & (F.pmod("lo", F.lit(FAILS_FIRST)) == FAILS_FIRST - 1)) | (
        (F.col("attempts") == 2) & (F.pmod("lo", F.lit(FAILS_TWICE)) == FAILS_TWICE - 1))
    return g.select(*key, F.when(fails, F.lit("Server busy")).otherwise(body).alias("body"))


class FeedPlan:
    """All intermediate tables of the feed for one test directory."""

    def __init__(self, spark: SparkSession, sf_dir: str, cut_lineage: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir
        self.cut_lineage = cut_lineage
        self._rounds: list[R.Round] = []

    def _cut(self, df: DataFrame, name: str) -> DataFrame:
        return materialize(df, name, self.spark) if self.cut_lineage else df

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    # --- sending side ------------------------------------------------------
    @cached_property
    def feed_source(self) -> DataFrame:
        return events_as_feed(self.table("events"))

    @cached_property
    def schedule(self) -> DataFrame:
        # one row per (channel, day): written once so joins see its real (small) size
        return self._cut(W.demo_key_schedule(self.feed_source), "schedule")

    @cached_property
    def control_replies(self) -> DataFrame:
        return W.control_replies(self.schedule)

    @cached_property
    def wire(self) -> DataFrame:
        return W.demo_wire(self.feed_source, self.schedule)

    @cached_property
    def archive(self) -> DataFrame:
        f = self.feed_source
        return f.where(F.col("seq") % ARCHIVE_SKIPS_EVERY != 0).select("channel", "feed_date", "seq", "message")

    def archive_at(self, k: int) -> DataFrame:
        """The archive in the ``k``-th round (from 0): it knows more numbers from the second on."""
        if k == 0:
            return self.archive
        return self.feed_source.where(F.col("seq") % 10 != ARCHIVE_NEVER_HAS).select("channel", "feed_date", "seq", "message")

    # --- receiving side ----------------------------------------------------
    @cached_property
    def key_fold(self) -> DataFrame:
        return K.fold_replies(self.control_replies)

    @cached_property
    def key_epochs(self) -> DataFrame:
        return self._cut(K.key_epochs(self.key_fold), "key_epochs")

    @cached_property
    def decoded(self) -> DataFrame:
        return P.decode_packets(self.wire, self.key_epochs)

    @cached_property
    def parsed(self) -> DataFrame:
        return P.parse_fields(self.decoded)

    @cached_property
    def packets(self) -> DataFrame:
        return self._cut(P.complete_packets(self.parsed), "packets")

    @cached_property
    def gap_ranges(self) -> DataFrame:
        return self._cut(L.gap_ranges(self.packets), "gap_ranges")

    @cached_property
    def missing(self) -> DataFrame:
        return self._cut(L.expand_ranges(self.gap_ranges), "missing")

    @cached_property
    def requests(self) -> DataFrame:
        return R.request_batches(self.gap_ranges)

    def round(self, k: int) -> R.Round:
        """The ``k``-th round of requests (from 0), run when first asked for; the archive knows more numbers from the second on."""
        while len(self._rounds) <= k:
            later, last = self.archive_at(k), self._rounds[-1] if self._rounds else None
            self._rounds.append(R.recovery_round(last.left, last.pending, lambda r: archive_replies(r, later)) if last else self.first_round)
        return self._rounds[k]

    @cached_property
    def first_round(self) -> R.Round:
        return R.recovery_round(self.gap_ranges, None, lambda r: archive_replies(r, self.archive))

    @cached_property
    def backfilled(self) -> DataFrame:
        return R.backfill(self.missing, self.archive)

    @cached_property
    def recovered(self) -> DataFrame:
        """What the good replies of the first round brought."""
        return self.first_round.recovered.drop("attempts")

    @cached_property
    def still_missing(self) -> DataFrame:
        return R.still_missing(self.missing, self.recovered)

    @cached_property
    def pending(self) -> DataFrame:
        """Requests without an answer after two rounds."""
        return self.round(1).pending

    @cached_property
    def feed(self) -> DataFrame:
        """Live and recovered rows, written once: sinks, frames and numbering all read it."""
        return self._cut(R.merge_feed(self.packets, self.recovered), "feed")
