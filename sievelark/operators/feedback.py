"""Feedback events to preference sets: last write wins, set algebra, status of every event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelark.functions import text as X
from sievelark.operators.recall import known_label

#: Why an event is rejected. A queue tells an unknown item from one without an id; a table does not.
SUPERSEDED, INVALID = "superseded by newer event", "invalid label"
UNKNOWN_ITEM, NO_ID, NO_MAPPING = "item_id not found in manifest", "no semantic_paper_id", "no semantic_paper_id mapping"


def manifest_index(manifests: DataFrame, order: Column | list[Column]) -> DataFrame:
    """(run_id, item_id, semantic_paper_id): of entries of one run and item the last by `order` wins."""
    order = order if isinstance(order, list) else [order]
    g = manifests.groupBy("run_id", "item_id").agg(F.max_by("semantic_paper_id", F.struct(*order)).alias("semantic_paper_id"))
    return g.withColumn("semantic_paper_id", X.normalize_paper_id(F.col("semantic_paper_id")))


def resolve_events(events: DataFrame, index: DataFrame, own: str | None = "resolved_semantic_paper_id") -> DataFrame:
    """paper_id: the event's own id if it has one, else the manifest's for its run and item; null if neither.

    in_manifest: whether the manifest has the event's item."""
    m = index.select("run_id", "item_id", F.col("semantic_paper_id").alias("_m"), F.lit(True).alias("_in"))
    found = X.filled(F.col("_m"))
    if own:
        found = F.coalesce(F.nullif(X.normalize_paper_id(F.col(own)), F.lit("")), found)
    return events.join(m, ["run_id", "item_id"], "left").withColumns({"paper_id": found, "in_manifest": F.coalesce("_in", F.lit(False))}).drop("_m", "_in")


def pending(events: DataFrame) -> DataFrame:
    """The events not yet judged."""
    return events.where(F.lower(X.strip(F.col("status"))) == "pending")


def event_order(events: DataFrame, now: Column) -> list[Column]:
    """When an event was made, then its id; a time that is no ISO time counts as `now`. Tables without created_at are ordered by arrival."""
    at = X.iso_time(F.col("created_at"), now) if "created_at" in events.columns else F.col("received_at")
    return [at, F.col("event_id")]


def winners(events: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """The last event of each key by a total order, as one aggregate with map-side combine."""
    g = events.where(F.col(by).isNotNull()).groupBy(by).agg(F.max_by(F.struct(*events.columns), F.struct(*order)).alias("_r"))
    return g.select("_r.*")


def outcomes(events: DataFrame, order: list[Column], queue: bool = False) -> DataFrame:
    """outcome and reason of every event (with paper_id and in_manifest): applied, or rejected as invalid, unmapped or superseded.

    queue: an event without a paper is told as of an unknown item, or of an item without an id.

    The last place in the order of each paper is an aggregate with map-side combine, joined back to the
    events; no window holds a paper's events, so one paper may have a third of them. Events whose order
    is equal in all parts count alike."""
    label = known_label()
    df = events.withColumn("_at", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    good = label.isNotNull() & F.col("paper_id").isNotNull()
    last = df.where(good).groupBy("paper_id").agg(F.max("_at").alias("_last"))
    df = df.join(last, "paper_id", "left")
    reason = F.when(label.isNull(), INVALID).when(F.col("paper_id").isNull(), F.when(F.col("in_manifest"), NO_ID).otherwise(UNKNOWN_ITEM) if queue else F.lit(NO_MAPPING)).when(F.col("_at") != F.col("_last"), SUPERSEDED)
    return df.withColumns({"outcome": F.when(reason.isNull(), "applied").otherwise("rejected"), "reason": reason}).select(*events.columns, "outcome", "reason")


def counters(df: DataFrame) -> DataFrame:
    """Events applied, rejected, of invalid label and skipped as unmapped."""
    return df.agg(
        F.count_if(F.col("outcome") == "applied").alias("applied"), F.count_if(F.col("outcome") == "rejected").alias("rejected"),
        F.count_if(F.col("reason") == INVALID).alias("invalid"), F.count_if(F.col("reason").isin(UNKNOWN_ITEM, NO_ID, NO_MAPPING)).alias("skipped"),
    )


def merge_seeds(seeds: DataFrame, decided: DataFrame) -> DataFrame:
    """(paper_id, polarity) after decisions (paper_id, label): positive and negative set the polarity, undecided removes, others stay."""
    d = decided.select("paper_id", F.col("label").alias("_l"))
    both = seeds.select("paper_id", "polarity").join(d, "paper_id", "full_outer")
    return both.select("paper_id", F.coalesce("_l", "polarity").alias("polarity")).where("polarity in ('positive', 'negative')")


def seed_order(c: str = "paper_id") -> list[Column]:
    """CorpusId:<digits> first by number, then all others by their lower case."""
    digits = F.regexp_extract(c, r"^CorpusId:([0-9]+)$", 1)
    return [(digits == "").cast("int"), F.when(digits != "", F.lpad(digits, 20, "0")).otherwise(F.lower(c)), F.col(c)]


def apply_feedback(events: DataFrame, index: DataFrame, seeds: DataFrame, order: list[Column], own: str | None = "resolved_semantic_paper_id") -> tuple[DataFrame, DataFrame]:
    """(seeds after, every event with its outcome): one function behind file, queue and table front ends.

    own=None makes the manifest the only source of ids, as the queue does."""
    judged = outcomes(resolve_events(events, index, own), order, queue=own is None)
    decided = judged.where("outcome = 'applied'").select("paper_id", F.lower(X.strip(F.col("label"))).alias("label"))
    return merge_seeds(seeds, decided), judged


def latest_labels(entries: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last label of each key; of equal times the later position wins."""
    return entries.groupBy(*key).agg(F.max_by("label", F.struct(*order)).alias("label"))


def label_cascade(labels: DataFrame, manifest: DataFrame) -> DataFrame:
    """paper_id and how: by item_id, else by paper id, else by title and address. Of equal manifest keys the last entry (pos) wins."""
    last = lambda keys: manifest.groupBy(*keys).agg(F.max_by("semantic_paper_id", "pos").alias("_p"))
    m = manifest
    by_item = last(["item_id"]).withColumnRenamed("_p", "_a")
    by_paper = m.where("semantic_paper_id <> ''").select(F.col("semantic_paper_id").alias("_k2"), F.col("semantic_paper_id").alias("_b")).distinct()
    m3 = m.withColumns({"_t": X.spaced_title(F.col("title")), "_u": X.normalize_url(F.col("url"))})
    by_title = m3.groupBy("_t", "_u").agg(F.max_by("semantic_paper_id", "pos").alias("_c"))
    x = labels.withColumns({"_k2": X.normalize_paper_id(F.col("semantic_paper_id")), "_t": X.spaced_title(F.col("title")), "_u": X.normalize_url(F.col("url"))})
    x = x.join(by_item, "item_id", "left").join(by_paper, "_k2", "left").join(by_title, ["_t", "_u"], "left")
    how = F.when(F.col("_a").isNotNull(), "item_id").when(F.col("_b").isNotNull(), "paper_id").when(F.col("_c").isNotNull(), "title_url")
    return x.withColumns({"paper_id": F.coalesce("_a", "_b", "_c"), "matched_by": how}).drop("_a", "_b", "_c", "_k2", "_t", "_u")


def normalized(events: DataFrame) -> DataFrame:
    """Events with stripped texts, label and status in lower case, an empty status as pending and paper ids in one form."""
    texts = [c for c, t in events.dtypes if t == "string"]
    out = events.withColumns({c: X.strip(F.col(c)) for c in texts})
    fixed = {"label": F.lower("label"), "status": F.coalesce(F.nullif(F.lower("status"), F.lit("")), F.lit("pending")), "resolved_semantic_paper_id": X.normalize_paper_id(F.col("resolved_semantic_paper_id"))}
    return out.withColumns({c: f for c, f in fixed.items() if c in events.columns})


def file_labels(doc: dict, run: str) -> list[tuple[str, str, str, int, str, str, str]]:
    """Entries (item_id, label, at, pos, semantic_paper_id, title, url) of a reviewer's file, in order.

    The file must name the manifest's run, a reviewer and a time of review; entries without a time take the file's."""
    if str(doc.get("run_id") or "").strip() != run:
        raise ValueError("run_id of the file is not that of the manifest")
    at = str(doc.get("reviewed_at") or "").strip()
    if not str(doc.get("reviewer") or "").strip() or not at:
        raise ValueError("reviewer and reviewed_at are needed")
    text = lambda e, k: str(e.get(k) or "").strip()
    entries = [e for e in doc.get("labels") or [] if isinstance(e, dict)]
    return [(text(e, "item_id"), text(e, "label").lower(), text(e, "reviewed_at") or at, i, text(e, "semantic_paper_id"), text(e, "title"), text(e, "url")) for i, e in enumerate(entries)]
