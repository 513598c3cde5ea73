"""What follows from candidates and decisions: links and their roles, review buckets, proposals' states, shares, groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .linkage import ID_SIGNALS, linkable, strong_secondary

#: Buckets of review in the order in which they are shown.
CHOOSE, VERIFY, INVESTIGATE, COMBINED = "Choose the right row", "Verify a field", "Investigate — no clear DB match", "Confirm combined act"
CONFIRM, UNLINKED, OTHER = "Confirm the link", "DB row needs a Word link", "Non-accomandita (Word-only)"
BUCKETS = [CHOOSE, VERIFY, INVESTIGATE, COMBINED, CONFIRM, UNLINKED, OTHER]
#: Signals that together tell a row.
DATE_SIGNALS = ["registration_date_exact", "registration_date_stile_fiorentino"]
NAME_SIGNALS = ["person_name_overlap", "firm_name_overlap"]
#: Fixed value: how much more alike the primary of several siblings is than the next.
SIBLING_GAP = 0.15


def _any(signals: Column, names: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(signals, F.array(*map(F.lit, names))), F.lit(False))


def select_links(candidates: DataFrame, entries: DataFrame) -> DataFrame:
    """(entry_id, ordinal, row_id, role, needs_review): the rows that each entry is linked to.

    candidates: the ranked ones of each entry (linkage.top(), so a few rows) with row_id, db_table, contract_id,
    main_contract_id, sub_type, ratio and what linkable() and strong_secondary() read. entries: entry_id, status, combined
    (its label names several acts), several (its text does), numbers (all that it names). Every step is a window over
    entry_id, so candidates are shuffled once.
    """
    c, w = F.col, Window.partitionBy("entry_id")
    false = F.lit(False)
    x = candidates.join(entries.select("entry_id", "status", "combined", "several", "numbers"), "entry_id")
    x = x.withColumns({"strict": F.coalesce(linkable(), false), "loose": F.coalesce(linkable(True), false), "second": F.coalesce(strong_secondary(), false), "told": _any(c("signals"), ID_SIGNALS)})
    x = x.withColumns({"n_strict": F.count_if("strict").over(w), "n_loose": F.count_if("loose").over(w), "lead": F.min(F.when(c("strict"), c("rank"))).over(w)})
    chosen = (
        F.when(c("n_strict") >= 2, c("strict"))
        .when(c("combined") & (c("n_loose") >= 2), c("loose"))
        .when((c("status") == "matched_high_confidence") & (c("n_strict") >= 1), c("rank") == c("lead"))
        .when(c("status") == "matched_candidate", c("rank") == 1)
        .when(c("status").isin("matched_multiple", "ambiguous"), c("loose"))
        .otherwise(false)
    )
    x = x.withColumn("chosen", chosen).where(c("chosen") | c("several") & c("second"))
    x = x.withColumn("place", F.row_number().over(w.orderBy(F.desc("chosen"), "rank"))).where((c("place") == 1) | (c("db_table") != "contract") | c("told"))
    kind = F.lower(F.trim(F.coalesce("sub_type", F.lit(""))))
    hit = F.coalesce(F.array_contains("numbers", c("contract_id")), false) | F.coalesce(F.array_contains("numbers", c("main_contract_id")), false)
    x = x.withColumns({"kind": kind, "hit": hit, "like": F.coalesce("ratio", F.lit(0.0))})
    x = x.withColumns(
        {
            "n": F.count("*").over(w),
            "later": F.count_if(c("db_table") == "sub_contract").over(w),
            "parents": F.size(F.collect_set("main_contract_id").over(w)),
            "with_parent": F.count("main_contract_id").over(w),
            "kinds": F.size(F.collect_set("kind").over(w)),
            "untyped": F.count_if(c("kind") == "").over(w),
            "hits": F.count_if("hit").over(w),
            "likes": F.array_sort(F.collect_list("like").over(w)),
        }
    )
    siblings = ~c("several") & (c("n") >= 2) & (c("later") == c("n")) & ((c("parents") == 1) & (c("with_parent") == c("n")) | (c("kinds") == 1) & (c("untyped") == 0))
    gap = F.try_element_at("likes", F.lit(-1)) - F.try_element_at("likes", F.lit(-2)) >= SIBLING_GAP
    mine = F.when(c("hits") == 1, c("hit")).when(gap, c("like") == F.try_element_at("likes", F.lit(-1)))
    x = x.withColumn("role", F.when(siblings & ~F.coalesce(mine, F.lit(True)), "alternative").otherwise("primary"))
    x = x.withColumns({"ordinal": F.row_number().over(w.orderBy(F.desc("role"), "place")), "primaries": F.count_if(c("role") == "primary").over(w)})
    review = (c("primaries") != 1) | (c("role") == "alternative") | (F.size("conflicts") > 0) | (c("status") != "matched_high_confidence")
    return x.select("entry_id", "ordinal", "row_id", "role", review.alias("needs_review"))


def bucket(status: Column, label: Column, primaries: Column, signals: Column, conflicts: Column, strength: Column) -> Column:
    """What a reviewer has to do with an entry; strength is that of the best candidate's text."""
    right = _any(signals, ID_SIGNALS) | _any(signals, DATE_SIGNALS) & _any(signals, NAME_SIGNALS) | (F.coalesce(strength, F.lit(0.0)) >= 0.6)
    several = primaries > 1
    return (
        F.when(status == "word_only", F.when(label == "without_accomandita", OTHER).otherwise(INVESTIGATE))
        .when(status.isin("ambiguous", "matched_multiple"), F.when(several, COMBINED).otherwise(CHOOSE))
        .when(F.size(conflicts) > 0, F.when(right, VERIFY).otherwise(CHOOSE))
        .otherwise(F.when(several, COMBINED).otherwise(CONFIRM))
    )


def bucket_rank(name: Column) -> Column:
    """Place of a bucket in the order of review, from 0; null for an unknown one."""
    return F.nullif(F.array_position(F.array(*map(F.lit, BUCKETS)), name), F.lit(0)) - 1


def preselected(name: Column, primaries: Column, suggested: Column, best: Column) -> Column:
    """Rows that are ticked when a case is opened: none where the row is in doubt, all primaries of a combined act, else
    the one row or the best of several."""
    none = F.slice(suggested, 1, 0)
    return (
        F.when(name.isin(CHOOSE, INVESTIGATE, UNLINKED, OTHER), none)
        .when(name == COMBINED, F.when(F.size(primaries) > 0, primaries).otherwise(suggested))
        .when(F.size(suggested) <= 1, suggested)
        .otherwise(F.when(best.isNotNull(), F.array(best)).otherwise(none))
    )


def joint_changes(investor: DataFrame, investor_group: DataFrame) -> DataFrame:
    """(investor_id, investment_id, before, after): rows whose is_joint does not say whether two or more live people hold
    the stake. Stakes are counted before the join back, so a stake that many hold is aggregated on the map side."""
    live = investor.where("is_deleted = 0").select("investor_id", (F.coalesce(F.col("is_joint"), F.lit(0)) == 1).cast("int").alias("before"))
    held = investor_group.where("is_deleted = 0").select("investor_id", "investment_id").join(live, "investor_id")
    n = held.groupBy("investment_id").agg((F.count("*") >= 2).cast("int").alias("after"))
    return held.join(n, "investment_id").where("before <> after").select("investor_id", "investment_id", "before", "after")


def proposal_states(proposals: DataFrame, log: DataFrame) -> DataFrame:
    """(proposal_id, status, decided, applied, reverted): where each proposal stands, with the steps (seq) that led there.

    proposals: proposal_id, before, live (values). log: proposal_id, action (approve, reject, apply, revert), seq. A
    proposal is decided once, applied only after its approval and while the live value is still the one before, and
    reverted only after that; other steps change nothing. A state is the first step of its kind after the former, so
    three joins with an aggregate each, all by proposal_id, give it and no history is gathered.
    """

    def first(steps: DataFrame, name: str, after: str | None, *actions: str) -> DataFrame:
        s = log.where(F.col("action").isin(*actions)).select(F.col("proposal_id").alias("of"), "seq", "action")
        met = (F.col("proposal_id") == F.col("of")) & (F.col("seq") > F.col(after) if after else F.lit(True))
        return steps.join(s, met, "left").groupBy(*steps.columns).agg(F.min(F.when(F.col("of").isNotNull(), F.struct("seq", "action"))).alias(name))

    steps = first(proposals, "d", None, "approve", "reject").withColumn("decided", F.col("d.seq")).withColumn("open", F.when((F.col("d.action") == "approve") & F.col("before").eqNullSafe(F.col("live")), F.col("d.seq")))
    steps = first(steps, "a", "open", "apply").withColumn("applied", F.col("a.seq"))
    steps = first(steps, "r", "applied", "revert").withColumn("reverted", F.col("r.seq"))
    status = F.when(F.col("reverted").isNotNull(), "reverted").when(F.col("applied").isNotNull(), "applied").when(F.col("d.action") == "approve", "approved").when(F.col("d.action") == "reject", "rejected").otherwise("proposed")
    return steps.select("proposal_id", status.alias("status"), "decided", "applied", "reverted")


def funnel(df: DataFrame, steps: list[tuple[str, Column]], leaves: list[tuple[str, Column]] = ()) -> DataFrame:
    """(step, n): rows that pass each test and all before it; leaves are tested on what passes all. One pass."""
    tests, passed = [], F.lit(True)
    for name, test in steps:
        passed = passed & F.coalesce(test, F.lit(False))
        tests.append((name, passed))
    tests += [(name, passed & F.coalesce(test, F.lit(False))) for name, test in leaves]
    counts = df.agg(*[F.count_if(test).alias(f"n{k}") for k, (_, test) in enumerate(tests)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(name).alias("step"), F.col(f"n{k}").alias("n")) for k, (name, _) in enumerate(tests)])))


def resolution_groups(resolved: DataFrame) -> DataFrame:
    """(key, confidence, members, first_id): places that resolve to the same, as sure as the least sure of them.

    Parishes and areas are told apart by their own spelling (column signature), all others by modern_name, feature_type,
    is_area and admin_region; places of unknown type are left out.
    """
    own = F.col("feature_type").isin("parish", "area")
    low = [F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in ("modern_name", "admin_region")]
    key = F.when(own, F.concat_ws("|", F.lit("verbatim"), "signature")).otherwise(F.concat_ws("|", low[0], "feature_type", F.col("is_area").cast("string"), low[1]))
    rows = resolved.where("feature_type <> 'unknown'").groupBy(key.alias("key"))
    return rows.agg(F.min("confidence").alias("confidence"), F.count("*").alias("members"), F.min("place_id").alias("first_id")).where("members >= 2")


def sized_points(points: DataFrame) -> DataFrame:
    """points (n: uses) with size, 0 to 1 on a log scale of the largest n; the largest is one row, joined by broadcast."""
    most = points.agg(F.max("n").alias("most"))
    return points.join(F.broadcast(most)).withColumn("size", F.coalesce(F.try_divide(F.log1p("n"), F.log1p("most")), F.lit(0.0))).drop("most")


def within_radius(asked: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """(asked_id, point_id): points (point_id, x, y) no farther than radius from each asked (asked_id, x, y).

    An equi join on cells of the radius's width: each asked point looks into its cell and the eight around.
    """
    near = F.explode(F.array(*[F.lit(d) for d in (-1, 0, 1)]))
    cell = {f"c{v}": F.floor(F.col(v) / radius) for v in "xy"}
    a = asked.select("asked_id", F.col("x").alias("ax"), F.col("y").alias("ay"), *(c.alias(k) for k, c in cell.items()))
    a = a.withColumn("dx", near).withColumn("dy", near).withColumns({"cx": F.col("cx") + F.col("dx"), "cy": F.col("cy") + F.col("dy")}).drop("dx", "dy")
    p = points.select("point_id", "x", "y", *(c.alias(k) for k, c in cell.items()))
    return a.join(p, ["cx", "cy"]).where(F.hypot(F.col("x") - F.col("ax"), F.col("y") - F.col("ay")) <= radius).select("asked_id", "point_id")


def image_links(entries: DataFrame, folios: DataFrame) -> DataFrame:
    """(entry_id, path, folio, role): scans of the leaves where entries start and end, each once, with its first role.

    entries: entry_id, register_id, folio_start, folio_end. folios: register_id, folio, path.
    """
    ends = F.array(*[F.struct(F.col(c).alias("folio"), F.lit(role).alias("role"), F.lit(k).alias("nth")) for k, (c, role) in enumerate((("folio_start", "start"), ("folio_end", "end")))])
    e = entries.select("entry_id", "register_id", F.inline(ends)).where("folio is not null")
    met = e.join(folios.select("register_id", "folio", "path"), ["register_id", "folio"])
    return met.groupBy("entry_id", "path", "folio").agg(F.min_by("role", "nth").alias("role"))
