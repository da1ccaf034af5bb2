"""URL filters: host and path rules, and the ratio of two character language models."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, numbered, scratch

#: (verdict, rule): a rule is a host and the beginning of a path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: One labelled URL in HELD calibrates the limit, the rest give the counts.
HELD = 5
#: What fitted() takes of each verdict at most, for the counts and for the limit. judge() has no such bounds.
TRAIN, SAMPLE = 10_000, 4000
#: Parts of a log-likelihood that sums are made of, so that no order of adding changes them.
PARTS = 2**36
#: Characters of a context at most.
ORDER = 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: then up to ?, # or the end; else empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda x: len(x[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def grams(text: str, order: int = ORDER) -> list[str]:
    """Each character of a text and its end, with the contexts of up to `order` characters before it."""
    t = "\x02" * order + text + "\x03"
    return [t[i - k : i + 1] for i in range(order, len(t)) for k in range(order + 1)]


class CharModel:
    """Character model of variable order: counts of characters after contexts of up to `order` characters, interpolated from
    the longest context seen down to a uniform distribution with Witten-Bell weights."""

    def __init__(self, seen: dict[str, int], order: int = ORDER):
        self.order, self.seen, self.after = order, seen, {}
        for gram, n in seen.items():
            x = self.after.setdefault(gram[:-1], [0, 0])
            x[0] += n
            x[1] += 1

    def log_likelihood(self, text: str) -> float:
        text, total = "\x02" * self.order + text + "\x03", 0.0
        seen, after = self.seen, self.after
        for i in range(self.order, len(text)):
            p = 1 / 256
            for k in range(self.order + 1):
                x = after.get(text[i - k : i])
                if x is None:
                    break
                p = (seen.get(text[i - k : i + 1], 0) + x[1] * p) / (x[0] + x[1])
            total += math.log(p)
        return total


def normal(url: str | None) -> str:
    """What the models see of a URL: without the scheme, in lower case."""
    return (url or "").partition("://")[2].lower() or (url or "").lower()


class Ratio:
    """Mean log-likelihood difference for each character, accepted minus rejected, and the limit under which a URL is
    blocked: the one with the best balanced accuracy on the held-out labelled URLs."""

    def __init__(self, accepted: dict[str, int], rejected: dict[str, int], held: tuple[list[str], list[str]] = ((), ())):
        self.good, self.bad, self.limit = CharModel(accepted), CharModel(rejected), 0.0
        if held[0] and held[1]:
            good, bad = (np.sort([self.score(t) for t in x]) for x in held)
            tried = np.unique(np.concatenate([good, bad]))
            tried = np.concatenate([[0.0], (tried[1:] + tried[:-1]) / 2])
            right = np.searchsorted(bad, tried) / len(bad) + 1 - np.searchsorted(good, tried) / len(good)
            best = tried[right >= right.max() - 1e-12]
            self.limit = float(best[np.argmin(np.abs(best))])

    def score(self, text: str) -> float:
        return (self.good.log_likelihood(text) - self.bad.log_likelihood(text)) / (len(text) + 1)


def _sampled(labelled: DataFrame, total: int, most: int) -> list[str]:
    """`most` of the URLs at most, those with the least hashes, as the models see them."""
    own = labelled.select("url", F.xxhash64("url", F.lit(6)).alias("h"))
    # a share of the hashes first, so that tasks send the driver few more URLs than it takes
    share = min(1.0, (1.2 * most + 100) / max(total, 1))
    own = own.where(F.col("h") <= F.lit(min(2**63 - 1, int((share * 2 - 1) * 2**63))).cast("long"))
    return [normal(r.url) for r in own.orderBy("h", "url").limit(most).collect()]


def fitted(labelled: DataFrame, sample: int = SAMPLE, train: int = TRAIN) -> Ratio | None:
    """The ratio of a bounded sample of labelled (said, url), each URL once, as one object for a look at the models; judge() counts
    all labelled URLs and does not use it. None without URLs of both verdicts. With fewer than HELD URLs of a
    verdict none of its are held out, and the limit is 0. All counts of the sampled URLs are used, whatever their number."""
    part = F.pmod(F.xxhash64("url", F.lit(5)), F.lit(HELD)) == 0
    sizes = {(r.said, r.held): r.n for r in labelled.groupBy("said", part.alias("held")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = {s: sizes.get((s, True), 0) + sizes.get((s, False), 0) for s in ("allow", "block")}
    if not all(total.values()):
        return None
    apart = all(sizes.get((s, h), 0) and total[s] >= HELD for s in total for h in (True, False))
    counts, held = {}, {}
    for said in total:
        own = labelled.where(F.col("said") == said)
        counts[said] = Counter()
        for url in _sampled(own.where(~part) if apart else own, sizes.get((said, False), 0) if apart else total[said], train):
            counts[said].update(grams(url))
        held[said] = _sampled(own.where(part), sizes.get((said, True), 0), sample) if apart else []
    return Ratio(dict(counts["allow"]), dict(counts["block"]), (held["allow"], held["block"]))


def _windows(texts: DataFrame) -> DataFrame:
    """(id, gram, kind) for each character and end of the URLs of texts (id, url, kind), as the models see them: the character
    after the longest context, of which all shorter ones are ends."""

    def run(batches):
        for b in batches:
            ids, out, kinds = [], [], []
            for i, url, kind in zip(*(b.column(c).to_pylist() for c in range(3))):
                t = "\x02" * ORDER + normal(url) + "\x03"
                for at in range(0, len(t) - ORDER, 100_000):
                    new = [t[j : j + ORDER + 1] for j in range(at, min(at + 100_000, len(t) - ORDER))]
                    out += new
                    ids += [i] * len(new)
                    kinds += [kind] * len(new)
                    if len(out) >= 100_000:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string()), pa.array(kinds, pa.string())], names=["id", "gram", "kind"])
                        ids, out, kinds = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string()), pa.array(kinds, pa.string())], names=["id", "gram", "kind"])

    return texts.select("id", "url", "kind").mapInArrow(run, "id long, gram string, kind string")


def _ratios(seen: DataFrame) -> DataFrame:
    """(gram, ratio): the log-likelihood of a gram's last character after the rest, accepted less rejected, in PARTS, for the grams
    of ORDER + 1 characters in seen (gram, allow, block), by the rule of CharModel. Shorter grams are ends of these, so their
    counts are sums; a context has no more followers than there are characters."""
    found = None
    for k in range(ORDER + 1):
        now = seen.groupBy(F.substring("gram", ORDER + 1 - k, k + 1).alias("gram")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        context = Window.partitionBy(F.substring("gram", 1, k))
        now = now.select("*", *[F.sum(c).over(context).alias(f"n_{c}") for c in ("allow", "block")], *[F.sum((F.col(c) > 0).cast("long")).over(context).alias(f"types_{c}") for c in ("allow", "block")])
        if found is None:
            now = now.withColumn("p_allow", F.lit(1 / 256)).withColumn("p_block", F.lit(1 / 256))
        else:
            now = now.withColumn("end", F.substring("gram", 2, k)).join(found.withColumnRenamed("gram", "end"), "end")
        p = lambda c: F.when(F.col(f"n_{c}") > 0, (F.col(c) + F.col(f"types_{c}") * F.col(f"p_{c}")) / (F.col(f"n_{c}") + F.col(f"types_{c}"))).otherwise(F.col(f"p_{c}"))
        found = now.select("gram", p("allow").alias("p_allow"), p("block").alias("p_block"))
    return found.select("gram", F.round((F.log("p_allow") - F.log("p_block")) * PARTS).cast("long").alias("ratio"))


def _limit(held: DataFrame) -> float:
    """The limit with the best balanced accuracy on all of held (said, score), as Ratio finds it: 0 or between two scores, of equally
    good ones the least. Scores are summed up by places of 1/1024, and in each place in order."""
    one = held.groupBy("score").agg(F.count(F.when(F.col("said") == "allow", 1)).alias("g"), F.count(F.when(F.col("said") == "block", 1)).alias("b"))
    one = scratch(one.withColumn("place", F.floor(F.col("score") * 1024)), "scores")
    order = Window.orderBy("place")  # one row for each place
    places = one.groupBy("place").agg(F.sum("g").alias("gs"), F.sum("b").alias("bs"), F.min("score").alias("low"))
    places = places.select("place", (F.sum("gs").over(order) - F.col("gs")).alias("g0"), (F.sum("bs").over(order) - F.col("bs")).alias("b0"), F.lead("low").over(order).alias("next"))
    good, bad, under, over = one.agg(F.sum("g"), F.sum("b"), F.sum(F.when(F.col("score") < 0, F.col("b")).otherwise(0)), F.sum(F.when(F.col("score") >= 0, F.col("g")).otherwise(0))).first()
    within = Window.partitionBy("place").orderBy("score")
    tried = one.join(places, "place").select("score", (F.col("g0") + F.sum("g").over(within)).alias("g"), (F.col("b0") + F.sum("b").over(within)).alias("b"), F.coalesce(F.lead("score").over(within), "next").alias("after"))
    right = F.col("b") * F.lit(good) + (F.lit(good) - F.col("g")) * F.lit(bad)
    best = tried.where("after is not null").select(right.alias("right"), ((F.col("score") + F.col("after")) / 2).alias("limit")).orderBy(F.desc("right"), F.abs("limit"), "limit").first()
    discard(one)
    zero = (under * good + over * bad, 0.0)
    return zero[1] if best is None or best.right <= zero[0] else best.limit


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, url, host, path, rule, score, verdict) for each row of pages (page_id, url).

    URLs that a rule fits are judged by it, and label the others: the models count all of them, each URL once, but one in HELD, and
    all of those calibrate the limit. Every other URL is judged by its score. No model is held by a task: URLs are cut into
    characters with their contexts, which are joined with what the counts say of them. Without labelled URLs of
    both verdicts, what no rule blocks is allowed. With fewer than HELD URLs of a verdict none of its are held out, and the limit
    is 0. Null and empty URLs, or those without ://: empty host and path, judged
    by score. Repeated rows each get their verdict; an empty table gives an empty result; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("said", verdict)
    held = F.pmod(F.xxhash64("url", F.lit(5)), F.lit(HELD)) == 0
    urls = numbered(rows.select("url", "said").distinct().withColumn("held", held), "id")
    sizes = {(r.said, r.held): r.n for r in urls.where("said is not null").groupBy("said", "held").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = {s: sizes.get((s, True), 0) + sizes.get((s, False), 0) for s in ("allow", "block")}
    out = ("page_id", "url", "host", "path", "rule", "score", "verdict")
    if not all(total.values()):
        return rows.withColumn("score", F.lit(None).cast("double")).withColumn("verdict", F.coalesce("said", F.lit("allow"))).select(*out)
    apart = all(sizes.get((s, h), 0) and total[s] >= HELD for s in total for h in (True, False))
    texts = urls.withColumn("kind", F.when(F.col("said").isNotNull() & ~(F.lit(apart) & F.col("held")), F.col("said")))
    count = lambda c: F.count(F.when(F.col("kind") == c, 1)).alias(c)
    seen = scratch(_windows(texts).groupBy("gram").agg(count("allow"), count("block")), "grams")
    ratios = scratch(_ratios(seen), "ratios")
    sums = _windows(texts.where("kind is null")).select("id", "gram").join(ratios, "gram").groupBy("id").agg((F.sum("ratio") / PARTS / F.count(F.lit(1))).alias("score"))
    scores = scratch(urls.join(sums, "id").select("url", "said", "score"), "scored")
    limit = _limit(scores.where("said is not null").select("said", "score")) if apart else 0.0
    discard(seen, ratios, urls)
    judged = scores.where("said is null").select(F.col("url").alias("scored"), "score")
    judged = rows.join(judged, F.col("said").isNull() & F.col("url").eqNullSafe(F.col("scored")), "left")
    return judged.withColumn("verdict", F.coalesce("said", F.when(F.col("score") >= limit, "allow").otherwise("block"))).select(*out)
