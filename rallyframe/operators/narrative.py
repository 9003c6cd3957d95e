"""Plain-English text columns from the statistics tables.

``profile`` packs what the texts of a player need into one row; its arrays hold one entry per shot type,
rally class or serve zone, a fixed handful. Texts are templates filled with columns.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyframe import constants as K
from rallyframe.functions import scalars as S
from rallyframe.operators import momentum, stats
from rallyframe.operators.points import rows_in_points
from rallyframe.operators.quantiles import mean_in_order
from rallyframe.operators.scan import Agg, row_numbers, scan
from rallyframe.session import pin

ON = ["match_id", "owner"]


def fill(template: str, **cols: Column | str) -> Column:
    """Text template with {name} slots filled by columns (null when a slot is null)."""
    parts = re.split(r"\{(\w+)\}", template)
    out = [F.lit(p) if i % 2 == 0 else cols[p] for i, p in enumerate(parts) if i % 2 or p]
    return F.concat(*[o if isinstance(o, Column) else F.lit(o) for o in out])


def n0(c: Column) -> Column:
    return F.bround(c).cast("bigint").cast("string")


def n1(c: Column) -> Column:
    return F.format_string("%.1f", F.bround(c, 1))


def js0(c: Column) -> Column:
    return F.round(c).cast("bigint").cast("string")


def sentences(*cols: Column, sep: str = " ") -> Column:
    return F.array_join(F.array_compact(F.array(*cols)), sep)


def name_of(c: str = "owner") -> Column:
    return S.player_name(c)


def other_name(c: str = "owner") -> Column:
    return F.when(F.col(c) == "player_a", "Player B").otherwise("Player A")


# --- player profile -----------------------------------------------------------------------------

def profile(points: DataFrame, shots: DataFrame, coverage: DataFrame | None = None, rebuilt: bool = False) -> DataFrame:
    """One row per match and player. ``rebuilt`` takes errors and wins from the by-time reconstruction."""
    pct = lambda c: F.round(c, 1)
    seen = shots.groupBy(*ON, stats.shot_type().alias("shot_type")).agg(F.min("frame_idx").alias("seen"))
    mix = stats.shot_mix(shots).join(seen, [*ON, "shot_type"])
    types = mix.groupBy(*ON).agg(F.sum("n").alias("total_shots"), F.sort_array(F.collect_list(F.struct(
        (-F.col("n")).alias("o"), "seen", "shot_type", "n", pct("pct").alias("pct")))).alias("types"))
    dirs = shots.groupBy(*ON, stats.shot_type().alias("shot_type"), F.coalesce("direction", F.lit("unknown")).alias("direction")).agg(
        F.count(F.lit(1)).alias("n"), F.min("frame_idx").alias("dseen"))
    dirs = dirs.withColumn("pct", pct(S.percent("n", F.sum("n").over(Window.partitionBy(*ON, "shot_type")))))
    top = dirs.groupBy(*ON, "shot_type").agg(F.min(F.struct((-F.col("pct")).alias("o"), "dseen", "direction", "pct")).alias("d"),
                                             F.sum("n").alias("n"), F.min("dseen").alias("seen"))
    top = top.groupBy(*ON).agg(F.sort_array(F.collect_list(F.struct(
        "seen", "shot_type", "n", F.col("d.direction").alias("direction"), F.col("d.pct").alias("pct")))).alias("dirs"))
    last = None if rebuilt else pin(stats.with_last_shot(points, shots))
    by_type = stats.rebuilt_errors_by_type(points, shots) if rebuilt else stats.errors_by_type(points, shots, last)
    errs = by_type.groupBy(*ON).agg(F.sort_array(F.collect_list(F.struct(
        F.col("first_at").alias("at"), "shot_type", "errors", pct("rate").alias("rate"), "made"))).alias("errors"))
    by_rally = stats.rebuilt_errors_by_rally(points, shots) if rebuilt else stats.errors_by_rally(points, shots, last)
    one = lambda b, c: F.max(F.when(F.col("bucket") == b, c))
    tags = {"1-3": "r1", "4-6": "r4", "7-9": "r7", "10+": "r10"}
    rally = by_rally.groupBy(*ON).agg(*[one(b, pct("rate")).alias(f"{t}_rate") for b, t in tags.items()],
                                      *[one(b, F.col("errors")).alias(f"{t}_errors") for b, t in tags.items()])
    served = points.filter("serve_player IS NOT NULL").groupBy("match_id", F.col("serve_player").alias("owner"), F.coalesce("serve_zone", F.lit("unknown")).alias("zone")).agg(
        F.min("point_idx").alias("zseen"))
    wins = stats.rebuilt_zone_wins(points, shots) if rebuilt else stats.serve_zone_wins(points)
    zones = wins.join(served, [*ON, "zone"]).groupBy(*ON).agg(F.sort_array(F.collect_list(F.struct(
        (-pct("win_pct")).alias("o"), "zseen", "zone", pct("win_pct").alias("win"), "serves"))).alias("zones"))
    d = types.join(top, ON).join(errs, ON, "left").join(rally, ON, "left").join(zones, ON, "left")
    d = d.join(stats.serve_summary(points).withColumn("first_serve_pct", pct("first_serve_pct")), ON, "left")
    d = d.join(stats.points_won_lost(points, shots), ON, "left").join(stats.average_speed(shots).drop("total_shots"), ON, "left")
    if coverage is None:
        return d.withColumns({c: F.lit(None).cast("double") for c in ("distance", "centre_x", "centre_y")})
    return d.join(coverage.select(*ON, "distance", "centre_x", "centre_y"), ON, "left")


def _long(c: str) -> Column:
    return F.greatest(F.coalesce(F.col(f"r7_{c}"), F.lit(0)), F.coalesce(F.col(f"r10_{c}"), F.lit(0)))


def _long_errors() -> Column:
    return F.coalesce("r7_errors", F.lit(0)) + F.coalesce("r10_errors", F.lit(0))


def _short() -> Column:
    return F.greatest(F.coalesce("r1_rate", F.lit(0.0)), F.coalesce("r4_rate", F.lit(0.0)))


def _worst(skip=("neutral", "unknown")) -> Column:
    """Shot type with the highest error rate, the earliest error first on ties."""
    ok = F.filter("errors", lambda e: ~e.shot_type.isin(*skip))
    ranked = F.sort_array(F.transform(ok, lambda e: F.struct((-e.rate).alias("o"), e["at"].alias("a"), e.alias("e"))))
    return F.try_element_at(ranked, F.lit(1)).e


def _direction(d: Column, name: Column, template: str) -> Column:
    return fill(template, name=name, type=d.shot_type, dir=S.spaced(d.direction), pct=n1(d.pct), p0=n0(d.pct))


def exploit_plan() -> Column:
    """Most useful single hint against a player: long rallies, weak shot, readable direction."""
    name, opp, w = name_of(), other_name(), _worst()
    readable = F.filter("dirs", lambda d: ~d.shot_type.isin("neutral", "serve", "unknown") & (d.pct > 70) & (d.direction != "unknown"))
    d = F.try_element_at(readable, F.lit(1))
    return F.coalesce(
        F.when((_long("rate") > _short() + 15) & (_long_errors() >= 2), fill(
            "Keep the ball in play beyond shot 7: {name}'s errors climb from {a}% to {b}% once a rally is long ({n} points given away so far).",
            name=name, a=n0(_short()), b=n0(_long("rate")), n=_long_errors().cast("string"))),
        F.when((w.rate > 25) & (w.errors >= 2), fill(
            "Attack {name}'s {type} — {rate}% of them miss ({n} misses so far). Aim there when it matters.",
            name=name, type=w.shot_type, rate=n0(w.rate), n=w.errors.cast("string"))),
        fill("Expect {name}'s {type} — {pct}% go {dir}. Knowing this lets {opp} set up early.",
             name=name, type=d.shot_type, pct=n0(d.pct), dir=S.spaced(d.direction), opp=opp), F.lit(""))


def player_cards(prof: DataFrame, patterns: DataFrame) -> DataFrame:
    """Tendencies, serve, shot mix, coverage and exploit plan per player."""
    best = patterns.filter("rank = 1").select(*ON, F.struct("shot_type", "direction", F.round("pct", 1).alias("pct")).alias("best"))
    d = prof.join(best, ON, "left")
    name, dom, best = name_of(), F.col("types")[0], F.col("best")
    usual = F.transform(F.filter("dirs", lambda x: ~x.shot_type.isin("neutral", "serve") & (x.pct > 50) & (x.direction != "unknown")),
                        lambda x: _direction(x, name, "{name}'s {type} goes {dir} {pct}% of the attempts."))
    tend = F.concat(
        F.array_compact(F.array(F.when((dom.shot_type != "neutral") & (dom.pct > 30), fill("{name} relies mostly on {type}s ({pct}% of what they hit).", name=name, type=dom.shot_type, pct=n1(dom.pct))))),
        usual,
        F.array_compact(F.array(F.when(best.pct > 25, fill("{name}'s favourite combination is {type} {dir} ({pct}% of strokes).", name=name, type=best.shot_type, dir=S.spaced(best.direction), pct=n1(best.pct))))))
    tend = F.when(F.size(tend) > 0, tend).otherwise(F.array(fill("Too few shots to describe {name}'s habits.", name=name)))
    z = F.try_element_at("zones", F.lit(1))
    serve = F.when(F.col("first_serve_pct") > 0, F.concat(
        fill("{name} has a {pct}% of first serves in.", name=name, pct=n1(F.col("first_serve_pct"))),
        F.coalesce(F.when(z.win > 0, fill(" Best serving target: {zone} ({win}% of those points won).", zone=S.spaced(z.zone), win=n1(z.win))), F.lit("")))).otherwise("")
    mix = fill("Shots by type: {parts} (all: {n})", n=F.col("total_shots").cast("string"),
               parts=F.array_join(F.transform("types", lambda t: F.concat(t.shot_type, F.lit(": "), t.n.cast("string"))), ", "))
    cover = F.coalesce(F.when(F.col("distance") > 0, fill("{name} covered {d} court units around a mean spot of ({x}, {y}).", name=name, d=n0(F.col("distance")),
                                                          x=n0(F.col("centre_x")), y=n0(F.col("centre_y")))), F.lit(""))
    return d.select(*ON, tend.alias("tendencies"), serve.alias("serve_summary"), mix.alias("shot_distribution"), cover.alias("coverage_summary"), exploit_plan().alias("exploit_plan"))


def _numbered(d: DataFrame, items: Column, limit: int | None = 3) -> DataFrame:
    """Rule outputs of a player by severity, the rule order breaking ties; the first ``limit``, or all."""
    ranked = F.sort_array(F.transform(F.filter(items, lambda x: x.isNotNull()), lambda x: F.struct((-x.severity).alias("o"), x.rule.alias("r"), x.alias("w"))))
    d = d.select(*ON, F.posexplode(ranked if limit is None else F.slice(ranked, 1, limit)).alias("_p", "_x"))
    return d.select(*ON, (F.col("_p") + 1).alias("weakness_no"), "_x.w.description", "_x.w.data_point", "_x.w.points_cost", "_x.w.severity")


def _item(rule: int, cond: Column, description: Column, data_point: Column, cost: Column, severity: Column) -> Column:
    return F.when(cond, F.struct(F.lit(rule).alias("rule"), description.alias("description"), data_point.alias("data_point"),
                                 cost.cast("bigint").alias("points_cost"), severity.cast("double").alias("severity")))


def weakness_report(prof: DataFrame) -> DataFrame:
    """Up to three weaknesses per player: long rallies, weakest shot, readable direction."""
    name, opp, w = name_of(), other_name(), _worst()
    long, short, lost = _long("rate"), _short(), _long_errors()
    fatigue = _item(1, (long > short + 15) & (long > 25),
        fill("Against {name}: go beyond seven shots. Their misses grow from {a}% early on to {b}% after shot seven. That was worth {n} point{s} in the match.",
             name=name, a=n0(short), b=n0(long), n=lost.cast("string"), s=F.when(lost != 1, "s").otherwise("")),
        fill("{n} own errors from shot 7 on, against {a}% before shot 6", n=lost.cast("string"), a=n0(short)),
        lost, F.least((long - short) / 50, F.lit(1.0)))
    shot = _item(2, (w.rate > 20) & (w.errors >= 2),
        fill("{name}'s {type} is shaky when pressed: {rate}% of them miss ({n} errors from {m} tries). Aim at their {type} side on big points.",
             name=name, type=w.shot_type, rate=n0(w.rate), n=w.errors.cast("string"), m=w.made.cast("string")),
        fill("{n} errors / {m} {type}s ({rate}% error rate)", n=w.errors.cast("string"), m=w.made.cast("string"), type=w.shot_type, rate=n0(w.rate)),
        w.errors, F.least(w.rate / 100, F.lit(1.0)))
    # only the most frequent eligible type is looked at
    eligible = F.sort_array(F.transform(F.filter("dirs", lambda d: ~d.shot_type.isin("neutral", "serve", "unknown")),
                                        lambda d: F.struct((-d.n).alias("o"), d.shot_type.alias("t"), d.alias("d"))))
    d = F.try_element_at(eligible, F.lit(1)).d
    aim = _item(3, (d.pct > 70) & (d.direction != "unknown"),
        fill("{name} shows their {type} — {p0}% go {dir}. {opp} can move first and punish it.",
             name=name, type=d.shot_type, p0=n0(d.pct), dir=S.spaced(d.direction), opp=opp),
        fill("{p0}% of {type}s go {dir}", p0=n0(d.pct), type=d.shot_type, dir=S.spaced(d.direction)), F.lit(0), F.least(d.pct / 100, F.lit(0.8)))
    return _numbered(prof, F.array(fatigue, shot, aim))


def rebuilt_cards(prof: DataFrame, patterns: DataFrame) -> DataFrame:
    """Card texts of the rebuilt statistics (own thresholds 55 %, integer coverage)."""
    best = patterns.filter("rank = 1").select(*ON, F.struct("shot_type", "direction", F.round("pct", 1).alias("pct")).alias("best"))
    d = prof.join(best, ON, "left")
    name, dom, best = name_of(), F.col("types")[0], F.col("best")
    usual = F.transform(F.filter("dirs", lambda x: x.pct >= 55), lambda x: _direction(x, name, "{name}'s {type} goes {dir} {pct}% of the attempts."))
    tend = F.concat(F.array(fill("{name} relies mostly on {type}s ({pct}% of what they hit).", name=name, type=dom.shot_type, pct=n1(dom.pct))), usual,
                    F.array(fill("{name}'s favourite combination is {type} {dir} ({pct}% of strokes).", name=name, type=best.shot_type, dir=S.spaced(best.direction), pct=n1(best.pct))))
    weak = F.filter("errors", lambda e: (e.rate >= 30) & (e.errors >= 2))
    w = F.try_element_at(weak, F.lit(-1))
    plan = F.coalesce(fill("Attack {name}'s {type} — {rate}% of them miss ({n} misses so far). Aim there when it matters.", name=name, type=w.shot_type,
                           rate=n0(w.rate), n=w.errors.cast("string")), F.lit(""))
    z = F.try_element_at("zones", F.lit(1))
    in_order = F.sort_array(F.transform("zones", lambda q: F.struct(q.zseen.alias("a"), q.zone.alias("zone"), q.serves.alias("serves"))))
    serve = F.coalesce(fill("Serve zones: {parts}. Best zone: {zone} ({win}% of those points won).", zone=S.spaced(z.zone), win=n1(z.win),
        parts=F.array_join(F.transform(in_order, lambda q: F.concat(q.zone, F.lit(": "), q.serves.cast("string"))), ", ")), F.lit(""))
    cover = F.coalesce(F.when(F.col("distance") > 0, fill("{name} covered {d} court units around a mean spot of ({x}, {y}).", name=name, d=F.floor("distance").cast("string"),
                                                          x=F.floor("centre_x").cast("string"), y=F.floor("centre_y").cast("string"))), F.lit(""))
    return d.select(*ON, tend.alias("tendencies"), plan.alias("exploit_plan"), serve.alias("serve_summary"), cover.alias("coverage_summary"))


def rebuilt_weaknesses(prof: DataFrame) -> DataFrame:
    """All rebuilt weaknesses by severity: shots from 30 %, directions from 75 %, rally classes from 50 %."""
    name = name_of()
    item = lambda rule, desc, data, cost, sev: F.struct(rule.cast("int").alias("rule"), desc.alias("description"), data.alias("data_point"), cost.cast("bigint").alias("points_cost"), F.round(F.least(sev / 100, F.lit(1.0)), 3).alias("severity"))
    shot = F.transform(F.filter("errors", lambda e: (e.rate >= 30) & (e.errors >= 2)), lambda e, i: item(
        i, fill("{name}'s {type} is shaky when pressed: {rate}% of them miss ({n} errors from {m} tries). Aim at their {type} side on big points.",
                name=name, type=e.shot_type, rate=n0(e.rate), n=e.errors.cast("string"), m=e.made.cast("string")),
        fill("{n} errors / {m} {type}s ({rate}% error rate)", n=e.errors.cast("string"), m=e.made.cast("string"), type=e.shot_type, rate=n0(e.rate)), e.errors, e.rate))
    aim = F.transform(F.filter("dirs", lambda d: d.pct >= 75), lambda d, i: item(
        i + 10, fill("{name} shows their {type} — {p0}% go {dir}. Opponent can move first and punish it.", name=name, type=d.shot_type, p0=n0(d.pct), dir=S.spaced(d.direction)),
        fill("{p0}% of {type}s go {dir}", p0=n0(d.pct), type=d.shot_type, dir=S.spaced(d.direction)), F.lit(0), d.pct))
    def rally(k, b, t):
        rate, n = F.col(f"{t}_rate"), F.col(f"{t}_errors")
        return F.when((rate >= 50) & (n >= 2), item(F.lit(20 + k), fill(f"{{name}}'s misses pile up in {b}-shot rallies ({{rate}}%). Make the exchanges that long.", name=name, rate=n0(rate)),
                                                    fill(f"{{rate}}% error rate in {b}-shot rallies", rate=n0(rate)), n, rate))
    rallies = F.array(*[rally(k, b, t) for k, (b, t) in enumerate((("1-3", "r1"), ("4-6", "r4"), ("7-9", "r7"), ("10+", "r10")))])
    none = F.array().cast(prof.select(shot.alias("a")).schema["a"].dataType)
    return _numbered(prof, F.concat(F.coalesce(shot, none), F.coalesce(aim, none), rallies), None)


# --- match flow -----------------------------------------------------------------------------------

def flow_insights(points: DataFrame, rebuilt: bool = False) -> DataFrame:
    """Streaks, first-half / second-half rally length and overall rally length per match."""
    s = momentum.streaks(points)
    surge = fill("{name} won {n} points in a row and took over.", name=name_of("winner"), n=F.col("length").cast("string"))
    if not rebuilt:
        surge = F.when(F.col("final"), fill("{name} won the final {n} points in a row.", name=name_of("winner"), n=F.col("length").cast("string"))).otherwise(surge)
    s = s.select("match_id", F.lit("streak").alias("kind"), surge.alias("description"), "start_sec", "end_sec")
    d = scan(points, ["match_id"], ["point_idx"], _no=Agg("count", "upto", F.lit(1)), _n=Agg("count", "all", F.lit(1)))
    late = F.col("_no") > F.floor(F.col("_n") / 2)
    h = F.col("rally_hit_count")
    g = d.groupBy("match_id").agg(F.max("_n").alias("n"), F.avg(F.when(~late, h)).alias("early"), F.avg(F.when(late, h)).alias("late"), F.avg(h).alias("all"))
    up = F.col("late") > F.col("early")
    least, diff, long, short = (4, 2.0, 8, 4) if rebuilt else (6, 1.5, 7, 3)
    overall = F.col("all") if rebuilt else F.round("all", 1)
    change = fill("Mean exchange {way} from {a} shots before half-time to {b} shots after it", way=F.when(up, "increased").otherwise("decreased"), a=n1(F.col("early")), b=n1(F.col("late")))
    change = F.concat(change, F.lit(".")) if rebuilt else F.concat(change, F.when(
        up, ", so more was settled from the baseline.").otherwise(", perhaps from tired legs or caution."))
    brief = ("Brief exchanges (mean {a} shots): points were ended fast." if rebuilt
             else "Mostly brief exchanges (mean {a} shots): serve and attack decided.")
    entry = lambda kind, cond, text: F.when(cond, F.struct(F.lit(kind).alias("kind"), text.alias("description")))
    rows = F.array_compact(F.array(
        entry("trend", (F.col("n") >= least) & (F.abs(F.col("late") - F.col("early")) > diff), change),
        entry("short", (overall > 0) & (overall < short), fill(brief, a=n1(overall))),
        entry("long", overall > long, fill("Mostly long exchanges (mean {a} shots): a match from the baseline.", a=n1(overall)))))
    none = F.lit(None).cast("double")
    g = g.select("match_id", F.explode(rows).alias("r")).select("match_id", "r.*", none.alias("start_sec"), none.alias("end_sec"))
    return s.unionByName(g)


# --- points ---------------------------------------------------------------------------------------

def shot_digest(points: DataFrame, shots: DataFrame, head: int = 6) -> DataFrame:
    """First shots of each point as text (at most ``head`` of them are put together) and their number."""
    j = rows_in_points(shots.select("match_id", "frame_idx", "owner", "shot_type", "direction", "speed_m_s"), points)
    d = scan(j, ["match_id", "point_idx"], ["frame_idx"], _no=Agg("count", "upto", F.lit(1)), shots_in_point=Agg("count", "all", F.lit(1)))
    speed = F.coalesce(F.when(F.col("speed_m_s") != 0, fill(" ({v} m/s)", v=n0(F.col("speed_m_s")))), F.lit(""))
    text = fill("{who} {type} {dir}{speed}", who=F.when(F.col("owner") == "player_a", "A").otherwise("B"), type=F.coalesce("shot_type", F.lit("shot")),
                dir=F.coalesce("direction", F.lit("")), speed=speed)
    g = d.filter(F.col("_no") <= head).groupBy("match_id", "point_idx").agg(
        F.max("shots_in_point").alias("shots_in_point"), F.sort_array(F.collect_list(F.struct("_no", text.alias("t")))).alias("_s"))
    more = F.when(F.col("shots_in_point") > head, F.array(fill("... +{n} more", n=(F.col("shots_in_point") - head).cast("string")))).otherwise(F.array().cast("array<string>"))
    return g.select("match_id", "point_idx", "shots_in_point", F.array_join(F.concat(F.transform("_s", lambda s: s.t), more), " → ").alias("digest"))


def shot_sequence(points: DataFrame, shots: DataFrame) -> DataFrame:
    """Shots of each point as numbered rows (long form of the card's sequence)."""
    j = rows_in_points(shots.select("match_id", "frame_idx", "owner", "shot_type", "direction", "speed_m_s", "court_side"), points)
    d = row_numbers(j, ["match_id", "point_idx"], ["frame_idx"], "shot_no")
    return d.select("match_id", "point_idx", "shot_no", "owner", F.when(F.col("owner") == "player_a", "A").otherwise("B").alias("owner_short"),
                    stats.shot_type().alias("shot_type"), F.coalesce("direction", F.lit("unknown")).alias("direction"), "speed_m_s", "court_side")


def point_summaries(points: DataFrame, shots: DataFrame) -> DataFrame:
    """Add ``summary``: digest of the shots, one terminal phrase, serve zone."""
    d = points.join(shot_digest(points, shots), ["match_id", "point_idx"], "left")
    dur, hits = n1(F.col("end_sec") - F.col("start_sec")), F.col("rally_hit_count").cast("string")
    lead = F.coalesce(fill("{n}-shot rally ({d}s): {digest}", n=F.col("shots_in_point").cast("string"), d=dur, digest=F.col("digest")),
                      fill("Took {d}s with {h} hits seen.", d=dur, h=hits))
    fault = F.col("serve_fault_type")
    missed = F.coalesce(fault.isNotNull() & (F.col("rally_hit_count") <= 1), F.lit(False))
    r = F.col("end_reason")
    end = S.when_chain([
        (missed & (fault == "net"), "Served into net"), (missed & (fault == "long"), "Serve long"), (missed & (fault == "wide"), "Serve wide"),
        (missed, fill("Fault on serve ({f})", f=fault)), (r == "OUT", "Ball out"), (r == "NET", "Ball stopped by the net"), (r == "DOUBLE_BOUNCE", "Double bounce"),
        (r == "BALL_LOST", "Ball left the tracked area")], fill("End: {r}", r=r))
    zone = F.when(~missed, fill("Served to {z}", z=S.spaced("serve_zone")))
    return d.withColumn("summary", F.concat(sentences(lead, end, zone, sep=". "), F.lit(".")))


def suggestions(points: DataFrame, shots: DataFrame, prof: DataFrame) -> DataFrame:
    """Add ``suggestion``: the first rule that fits the last hitter, or an empty text."""
    d = stats.with_last_shot(points, shots).join(prof.withColumnRenamed("owner", "last_owner").select(
        "match_id", "last_owner", "errors", *[f"{t}_{c}" for t in ("r1", "r4", "r7", "r10") for c in ("rate", "errors")]), ["match_id", "last_owner"], "left")
    rep = momentum.repeated_direction(rows_in_points(shots.select("match_id", "frame_idx", "owner", "direction"), points))
    d = d.join(rep.select("match_id", "point_idx", F.col("direction").alias("_rep"), F.col("times").alias("_times")), ["match_id", "point_idx"], "left")
    name, opp, kind = name_of("last_owner"), other_name("last_owner"), F.coalesce("last_type", F.lit("shot"))
    rate = F.coalesce(F.try_element_at(F.filter("errors", lambda e: e.shot_type == kind), F.lit(1)).rate, F.lit(0.0))
    r, hits, dirn = F.col("end_reason"), F.col("rally_hit_count"), F.col("last_direction")
    text = S.when_chain([
        (F.col("last_owner").isNull(), ""),
        ((hits >= 7) & (_long("rate") > _short() + 15), fill("{opp}'s plan pays off: {name} fades when points last ({a}% missed against {b}% early on). Stay patient beyond shot 7.",
            opp=opp, name=name, a=n0(_long("rate")), b=n0(_short()))),
        ((r == "OUT") & (rate > 20) & ~kind.isin("neutral", "unknown"), fill("{name}'s {t} does not hold: {p}% missed so far. Keep asking for that shot.", name=name, t=kind, p=n0(rate))),
        ((r == "OUT") & dirn.isNotNull() & ~dirn.isin("unknown", ""), fill("{name} went for the {d} and overshot; they reach for it when pressed and it's costing them.", name=name, d=S.spaced(dirn))),
        (r == "OUT", fill("{name} went for more than was there and hit it out.", name=name)),
        (r == "NET", fill("{name}'s {t} caught the tape, probably hurried. Moving them wide should bring more of these.", name=name, t=kind)),
        (F.col("_rep").isNotNull(), fill("{name} went {d} {n} times running, which {opp} can wait for.", name=name, d=S.spaced("_rep"), n=F.col("_times").cast("string"), opp=opp)),
        (hits >= 5, fill("{h}-shot exchange, steady from both sides.", h=hits.cast("string")))], "")
    return d.withColumn("suggestion", text)


def point_cards(points: DataFrame, shots: DataFrame, prof: DataFrame) -> DataFrame:
    """Summary, pattern context and suggestion of every point; the shots themselves are ``shot_sequence``."""
    on = ["match_id", "point_idx"]
    s = point_summaries(points, shots).select(*on, "start_sec", "end_sec", "summary", "end_reason", "rally_hit_count", "confidence")
    c = momentum.repeated_errors(stats.with_last_shot(points, shots)).select(*on, "pattern_context")
    g = suggestions(points, shots, prof).select(*on, "suggestion")
    return s.join(c, on, "left").join(g, on, "left").na.fill({"pattern_context": "", "suggestion": ""})


def basic_cards(points: DataFrame, last_bounce_side: str = "last_bounce_side") -> DataFrame:
    """Summary and advice from the point alone; ``last_bounce_side`` is null unless the point ended on a bounce."""
    r, f, hits = F.col("end_reason"), F.col("serve_fault_type"), F.col("rally_hit_count")
    lead = fill("Point {i}: {h} hits in {d}s.", i=F.col("point_idx").cast("string"), h=hits.cast("string"), d=n1(F.col("end_sec") - F.col("start_sec")))
    serve = F.coalesce(fill("First ball hit the {z} box.", z=S.spaced("serve_zone")), fill("The serve was called out ({f}).", f=f))
    end = S.when_chain([(r == "OUT", "The last ball landed outside."),
                        (r == "DOUBLE_BOUNCE", "The ball touched the same side twice before anyone returned it."),
                        (r == "NET", "The net stopped the last ball."),
                        (r == "BALL_LOST", "The ball left the camera's view, most likely once play was over.")], fill("Ended by: {r}.", r=r))
    out, side = r == "OUT", F.col(last_bounce_side)
    advice = F.array_compact(F.array(
        S.when_chain([(f == "wide", "The serve missed wide; a target nearer the middle of the box leaves more room."),
                      (f == "long", "The serve missed long; more spin or less power brings it down in time."),
                      (f == "net", "The serve met the net; toss higher and swing up for more clearance.")]).cast("string"),
        S.when_chain([(out & (side == "near"), "The last ball missed on the near side; mind the depth."),
                      (out & side.isNotNull(), "The last ball missed on the far side; pick targets further inside.")]).cast("string"),
        S.when_chain([(hits >= 8, "A long exchange. Stamina is there; look for a ball to attack or follow to the net."),
                      ((hits <= 2) & (r != "BALL_LOST"), "Over quickly; get more balls back before going for it.")]).cast("string"),
        F.when(r == "DOUBLE_BOUNCE", "With a second bounce the player couldn't get there. A better ready position and split step would help."),
        F.when(r == "NET", "The net took the ball. Give returns and passing shots more height.")))
    advice = F.when(F.size(advice) > 0, F.array_join(advice, " ")).otherwise("A sound point. Keep it up.")
    return points.select("match_id", "point_idx", sentences(lead, serve, end).alias("summary"), advice.alias("suggestion"))


def fallback_cards(points: DataFrame) -> DataFrame:
    """Short cards when nothing but the points is known."""
    r, f, h = F.coalesce("end_reason", F.lit("UNKNOWN")), F.col("serve_fault_type"), F.col("rally_hit_count").cast("string")
    # Summary and suggestion per end reason, suggestion per serve fault.
    texts = {
        "OUT": ("Point ended with an out ball after {h} hits.", "Focus on keeping the ball within the court lines during extended rallies."),
        "BALL_LOST": ("Ball tracking was lost after {h} hits in this rally.", "This point may have ended due to a fast exchange or camera angle change."),
        "NET": ("Ball hit the net after {h} hits.", "Try adding more height over the net on approach shots."),
        "DOUBLE_BOUNCE": ("Double bounce detected after {h} hits.", "Work on court coverage to reach the ball before the second bounce."),
    }
    serve = {"wide": "Aim serves more toward the center of the service box.", "long": "Reduce serve power or add more topspin to keep it in the box.",
             "net": "Increase serve trajectory height to clear the net."}
    summary = S.when_chain([(r == k, fill(t, h=h)) for k, (t, _) in texts.items()], fill("Point ended ({r}) after {h} hits.", r=r, h=h))
    advice = S.when_chain([*[(f == k, t) for k, t in serve.items()], *[(r == k, t) for k, (_, t) in texts.items()]],
                          "Review the video clip for this point to identify improvement areas.")
    return points.select("match_id", "point_idx", F.concat(summary, F.coalesce(fill(" Serve fault: {f}.", f=f), F.lit(""))).alias("summary"), advice.alias("suggestion"))


def run_insights(run: DataFrame, events: DataFrame, points: DataFrame) -> DataFrame:
    """Sentences about data quality and results of a run from the run, event and point statistics."""
    d = run.join(events, "match_id", "left").join(points, "match_id", "left")
    n, s = F.col("frames"), lambda c: F.col(c).cast("string")
    share = lambda c: F.col(c) / n
    p2 = lambda c: F.regexp_replace(F.format_string("%.2f", F.round(c * 100, 2)), r"(\.\d)0$", "$1")
    kmh = lambda c: n0(F.col(c) * 3.6)
    lines = sentences(
        F.when(share("reliable_frames") >= 0.85, fill("Court found reliably: {r}/{n} frames ({p}%) have a trusted projection, mean error {e} px.",
            r=s("reliable_frames"), n=s("frames"), p=p2(share("reliable_frames")), e=F.coalesce(n1(F.col("avg_error_px")), F.lit("N/A")))).otherwise(
            fill("Court often not found: only {r}/{n} frames ({p}%) have a trusted projection.", r=s("reliable_frames"), n=s("frames"), p=p2(share("reliable_frames")))),
        fill("Ball speed: mean {a} km/h, max {m} km/h (capped at {cap} m/s).", a=kmh("avg_speed"), m=kmh("max_speed"), cap=str(K.SPEED_CAP)),
        F.when(share("ball_frames") < 0.5, fill("The ball is rarely seen ({p}%); replays, close-ups or a bad view are likely.", p=p2(share("ball_frames")))).otherwise(
            fill("Ball seen in {b}/{n} frames ({p}%).", b=s("ball_frames"), n=s("frames"), p=p2(share("ball_frames")))),
        F.when(share("b_frames") < 0.3, fill("Player B, on the far side, is seen in just {p}% of frames, as is usual when a player is far from the camera.", p=p2(share("b_frames")))),
        F.when(F.col("raw_detections") > F.col("kept_detections"), fill("Outside the court, {k} detections were dropped ({p}% of all; crowd, officials, ball kids).",
            k=(F.col("raw_detections") - F.col("kept_detections")).cast("string"), p=p2(F.col("noise_pct") / 100))),
        fill("Found {b} bounces and {h} hits in this segment.", b=s("bounces"), h=s("hits")),
        F.when(F.col("bounces") > 0, fill("Bounces called: {i} in, {o} out, on the singles court with {m} units of margin.", i=s("bounces_in"), o=s("bounces_out"), m=str(K.LINE_MARGIN))),
        fill("Play splits into {n} point(s), mean {a} hits each.", n=s("points"), a=n1(F.col("avg_hits"))),
        F.when(F.col("faults") > 0, fill("Serve faults: {f} ({k}).", f=s("faults"), k=F.col("fault_types"))))
    return d.select("match_id", lines.alias("insights"))


# --- report texts -----------------------------------------------------------------------------------

def _long_rate() -> Column:
    return F.coalesce("r7_rate", "r10_rate")


def match_stories(prof: DataFrame, weaknesses: DataFrame) -> DataFrame:
    """Report lead per player: dominant shot, top weakness, long rallies, record."""
    w = weaknesses.filter("weakness_no = 1").select(*ON, F.col("description").alias("_w"))
    d, dom = prof.join(w, ON, "left"), F.col("types")[0]
    share, label, total = dom.n / F.col("total_shots") * 100, name_of(), F.col("points_won") + F.col("points_lost")
    text = sentences(
        F.when(share > 30, fill("{l} is a {t} hitter above all ({p}% of strokes).", l=label, t=dom.shot_type, p=js0(share))), F.col("_w"),
        F.when(_long_rate() > 40, fill("Loses control as points go on: misses reach {p}% beyond shot seven.", p=js0(_long_rate()))),
        F.when(total > 0, fill("Won {w} of {t} points here.", w=F.col("points_won").cast("string"), t=total.cast("string"))))
    return d.select(*ON, F.when(text != "", text).otherwise(fill("{l} has nothing else to report.", l=label)).alias("story"))


def point_sentences(points: DataFrame, shots: DataFrame, prof: DataFrame, owner: str = "player_a") -> DataFrame:
    """One report sentence per point from the view of one player; the long-rally remark comes once per match."""
    own = shots.filter(F.col("owner") == owner)
    p = prof.filter(F.col("owner") == owner).select("match_id", _long_rate().alias("_lr"))
    usual = mean_in_order(own.filter("speed_m_s > 0"), ["match_id"], "frame_idx", "speed_m_s", 1, "_usual")
    d = stats.with_last_shot(points, own).join(p, "match_id", "left").join(usual, "match_id", "left")
    danger = F.coalesce((F.col("end_reason") == "BALL_LOST") & F.col("serve_fault_type").isNull() & (F.col("rally_hit_count") >= 7) & (F.col("_lr") > 40), F.lit(False))
    d = scan(d.withColumn("_danger", danger), ["match_id"], ["point_idx"], _before=Agg("max", "before", F.col("_danger").cast("int")))
    label = F.lit("Player A" if owner == "player_a" else "Player B")
    h, dur = F.col("rally_hit_count").cast("string"), n1(F.col("end_sec") - F.col("start_sec"))
    kind, dirn, v, r, f = F.col("last_type"), F.col("last_direction"), F.col("last_speed"), F.col("end_reason"), F.col("serve_fault_type")
    kmh, avg = js0(v * 3.6), F.col("_usual")
    full, some = kind.isNotNull() & dirn.isNotNull() & v.isNotNull(), kind.isNotNull()
    once = F.col("_danger") & (F.coalesce("_before", F.lit(0)) == 0)
    text = S.when_chain([
        (f == "long", fill("Long serve. {h} shots, over at once.", h=h)), (f == "net", fill("Net serve. {h} shots.", h=h)),
        (f.isNotNull(), fill("Fault on serve ({f}). {h} shots in all.", f=S.spaced(f), h=h)),
        ((r == "OUT") & full & (v > avg * 1.2), fill("{l} overhit a {t} {d} at {k} km/h - {x}% faster than usual, and out after {h} hits.",
            l=label, t=kind, d=dirn, k=kmh, x=js0((v / avg - 1) * 100), h=h)),
        ((r == "OUT") & full, fill("{l} failed with a {t} {d} ({k} km/h) after {h} hits. {s}s rally.", l=label, t=kind, d=dirn, k=kmh, h=h, s=dur)),
        ((r == "OUT") & some, fill("{t} mistake closed the point after {h} hits.", t=kind, h=h)),
        (r == "OUT", fill("Own error, out after {h} hits over {s}s.", h=h, s=dur)),
        ((r == "NET") & some & dirn.isNotNull(), fill("{l}'s {t} {d} met the net after {h} hits. {s}s rally.", l=label, t=kind, d=dirn, h=h, s=dur)),
        (r == "NET", fill("Ball stopped by the net ended a {h}-hit, {s}s rally.", h=h, s=dur)),
        ((r == "WINNER") & full, fill("{l} finished with a {t} {d} winner at {k} km/h. {h} hits, {s}s.", l=label, t=kind, d=dirn, k=kmh, h=h, s=dur)),
        ((r == "WINNER") & some, fill("{l} hit a {t} winner closing the {h}-hit rally.", l=label, t=kind, h=h)),
        (r == "WINNER", fill("Winner, in {l}'s favour after {h} hits.", l=label, h=h)),
        (r == "DOUBLE_BOUNCE", fill("Opponent couldn't get to the second bounce after {h} hits.", h=h)),
        (once, fill("{h} hits before the track broke off, and this is {l}'s weak stretch: misses reach {p}% at this length.", h=h, l=label, p=js0(F.col("_lr")))),
        ((r == "BALL_LOST") & some, fill("The track broke off in a {t} exchange. {h} hits, {s}s.", t=kind, h=h, s=dur)),
        (r == "BALL_LOST", fill("The track broke off after {h} hits. {s}s rally.", h=h, s=dur))], fill("{h}-hit rally over {s}s.", h=h, s=dur))
    return d.select("match_id", "point_idx", F.lit(owner).alias("owner"), text.alias("sentence"))


def weakness_context(weaknesses: DataFrame, prof: DataFrame) -> DataFrame:
    """Supporting figures for each weakness, chosen by words in its description."""
    d = weaknesses.join(prof, ON)
    has = lambda *w: F.lower("description").rlike("|".join(w))
    rate = lambda t: F.try_element_at(F.filter("errors", lambda e: e.shot_type == t), F.lit(1)).rate
    back = F.try_element_at(F.filter("dirs", lambda x: x.shot_type == "backhand"), F.lit(1))
    line = lambda cond, text: F.when(cond, text)
    lines = F.array_compact(F.array(
        line(has("backhand"), fill("-> {p}% error rate on backhands overall", p=js0(rate("backhand")))),
        line(has("backhand"), fill("-> Goes {d} {p}% of the time - predictable", d=S.spaced(back.direction), p=js0(back.pct))),
        line(has("forehand"), fill("-> {p}% error rate on forehands overall", p=js0(rate("forehand")))),
        line(has("rally", "long"), fill("-> {p}% error rate in rallies longer than 7 shots", p=js0(_long_rate()))),
        line(has("rally", "long"), fill("-> Only {p}% error rate in short rallies - big contrast", p=js0(F.col("r1_rate")))),
        line(has("serve") & (F.col("first_serve_pct") > 0), fill("-> First serve in: {p}%", p=js0(F.col("first_serve_pct")))),
        line(has("serve") & (F.col("double_faults") > 0), fill("-> Double faults this match: {n}", n=F.col("double_faults").cast("string")))))
    return d.select(*ON, "weakness_no", F.array_join(lines, " ").alias("context"))
