"""Trust history: merchant pins, counterparties, look-alike addresses and the block rollback.

A blocked scan must not teach the system anything, and what the system knows decides which scans are blocked. Every
row depends only on earlier rows, so iterating "derive what non-blocked rows teach, recompute the three dependent
checks" reaches the one consistent answer; a row of dependency depth k is final after k rounds. Only rows that can be
affected take part: rows of a domain seen with two payees, rows whose payee shares a look-alike block with another
address, and rows whose text holds such an address. That set is closed, so the rest never enters the loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import patterns as P
from ..functions.scalars import col
from ..functions.text import not_ascii, strip_invisible
from ..session import Workspace

MIN_SHARED = 4
ORDER = ("ms", "seq")


def order_of(prefix: str = "") -> Column:
    return F.struct(F.col(prefix + "ms").alias("ms"), F.col(prefix + "seq").alias("seq"))


def block_key(address) -> Column:
    """First and last four hex digits of an EVM address; null for other shapes."""
    a = col(address)
    return F.when(a.rlike(P.EVM_ADDRESS), F.concat(F.substring(a, 3, MIN_SHARED), F.right(a, F.lit(MIN_SHARED))))


def shared_prefix(a, b) -> Column:
    """Hex digits two EVM addresses share from the front (0-40)."""
    same = F.transform(F.sequence(F.lit(3), F.lit(42)), lambda i: F.substring(col(a), i, F.lit(1)) == F.substring(col(b), i, F.lit(1)))
    at = F.array_position(same, False)
    return F.when(at == 0, 40).otherwise(at - 1).cast("int")


def shared_suffix(a, b) -> Column:
    flip = lambda x: F.concat(F.lit("0x"), F.reverse(F.substring(col(x), 3, 40)))
    return shared_prefix(flip(a), flip(b))


def is_lookalike(a, b) -> Column:
    """Different EVM addresses sharing at least four hex digits at both ends."""
    return (col(a) != col(b)) & (block_key(a) == block_key(b))


def text_addresses(text, payee) -> Column:
    """Distinct EVM addresses written in a text, without the payee's own."""
    t = col(text)
    may = F.contains(t, F.lit("0x")) | not_ascii(t)          # hidden characters may sit between the two
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.when(may, strip_invisible(t)), F.lit(P.EVM_IN_TEXT), F.lit(0)), F.lower))
    found = F.coalesce(found, F.array().cast("array<string>"))
    return F.filter(found, lambda a: ~a.eqNullSafe(col(payee)))


# ---------------------------------------------------------------- what non-blocked rows teach

def derive_pins(rows: DataFrame, history: DataFrame | None = None, keys: tuple = ("domain",)) -> DataFrame:
    """First payee per domain over rows that teach: ``domain, pay_to, ms, seq`` (history is older than any row)."""
    d = rows.filter(F.col("domain").isNotNull() & F.col("pay_to_lc").isNotNull()).select(
        *keys, "ms", "seq", F.col("pay_to_lc").alias("pay_to"))
    if history is not None:
        d = d.unionByName(history.select(*keys, "ms", "seq", "pay_to"))
    return d.groupBy(*keys).agg(F.min(F.struct("ms", "seq", "pay_to")).alias("p")).select(*keys, "p.pay_to", "p.ms", "p.seq")


def derive_counterparties(rows: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """First outgoing row per (agent, payee): ``agent_key, pay_to, ms, seq``."""
    d = rows.filter((F.col("direction") == "outgoing") & F.col("agent_key").isNotNull() & F.col("pay_to_lc").isNotNull()).select(
        "agent_key", F.col("pay_to_lc").alias("pay_to"), "ms", "seq")
    if history is not None:
        d = d.unionByName(history.select("agent_key", "pay_to", "ms", "seq"))
    return d.groupBy("agent_key", "pay_to").agg(F.min(F.struct("ms", "seq")).alias("o")).select("agent_key", "pay_to", "o.ms", "o.seq")


def known_addresses(counterparties: DataFrame, pins: DataFrame) -> DataFrame:
    """Union of known addresses with their source and scope (an agent, or empty for pins)."""
    cp = counterparties.select(F.col("agent_key").alias("scope"), F.col("pay_to").alias("address"), "ms", "seq", F.lit("counterparty").alias("source"))
    first = pins.groupBy("pay_to").agg(F.min(F.struct("ms", "seq")).alias("o"))
    return cp.unionByName(first.select(F.lit("").alias("scope"), F.col("pay_to").alias("address"), "o.ms", "o.seq", F.lit("pin").alias("source")))


def join_pins(rows: DataFrame, pins: DataFrame) -> DataFrame:
    """Adds ``pin_pay_to`` and ``pin_ms`` when the domain was pinned strictly before the row."""
    p = pins.select("domain", F.col("pay_to").alias("_p"), F.struct("ms", "seq").alias("_o"))
    d = rows.join(p, "domain", "left")
    before = F.col("_o") < order_of()
    return d.withColumn("pin_pay_to", F.when(before, F.col("_p"))).withColumn("pin_ms", F.when(before, F.col("_o.ms"))).drop("_p", "_o")


def join_pins_with_clears(rows: DataFrame, clears: DataFrame) -> DataFrame:
    """Pins with operator clears: an epoch is the number of clears of the domain before the row."""
    marks = clears.select("domain", "ms").groupBy("domain", "ms").agg(F.count("*").alias("_n"))
    total = W.partitionBy("domain").orderBy("ms")
    marks = marks.select("domain", "ms", F.struct(F.sum("_n").over(total).alias("n")).alias("_epoch"))
    from .windows import asof_last
    d = asof_last(rows, marks, ["domain"], "_epoch", strict=False).withColumn("epoch", F.coalesce(F.col("_epoch.n"), F.lit(0))).drop("_epoch")
    pins = derive_pins(d, keys=("domain", "epoch")).select("domain", "epoch", F.col("pay_to").alias("_p"), F.struct("ms", "seq").alias("_o"))
    d = d.join(pins, ["domain", "epoch"], "left")
    return d.withColumn("pin_pay_to", F.when(F.col("_o") < order_of(), F.col("_p"))).drop("_p", "_o")


def join_counterparties(rows: DataFrame, counterparties: DataFrame) -> DataFrame:
    """Adds ``known_payee``: the same agent dealt with the payee strictly before."""
    c = counterparties.select("agent_key", F.col("pay_to").alias("pay_to_lc"), F.struct("ms", "seq").alias("_o"))
    d = rows.join(c, ["agent_key", "pay_to_lc"], "left")
    return d.withColumn("known_payee", F.coalesce(F.col("_o") < order_of(), F.lit(False))).drop("_o")


def pin_times_seen(rows: DataFrame, pins: DataFrame) -> DataFrame:
    """Adds ``times_seen``: sightings of the pinned payee on the domain up to and including the row."""
    from .windows import running_totals, spread_null
    p = pins.select("domain", F.col("pay_to").alias("_p"), F.struct("ms", "seq").alias("_o"))
    d = rows.join(p, "domain", "left").withColumn("_hit", F.coalesce(
        (F.col("_o") <= order_of()) & (F.col("_p") == F.col("pay_to_lc")), F.lit(False)).cast("bigint"))
    return running_totals(d.withColumn("_k", spread_null("domain")), ["_k"], {"times_seen": F.col("_hit")}).drop("_p", "_o", "_hit", "_k")


# ---------------------------------------------------------------- look-alikes

def _two_earliest(known: DataFrame, keys: list[str]) -> DataFrame:
    """The two earliest distinct addresses per key. They decide "some other address was known before" for every row."""
    w = W.partitionBy(*keys).orderBy("ms", "seq", "address")
    r = known.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 2)
    pick = lambda n, c: F.max(F.when(F.col("_r") == n, c))
    return r.groupBy(*keys).agg(pick(1, F.col("address")).alias("_a1"), pick(1, order_of()).alias("_o1"),
                                pick(2, F.col("address")).alias("_a2"), pick(2, order_of()).alias("_o2"))


def _other_known(address) -> Column:
    a, now = col(address), order_of()
    return F.coalesce(F.when(F.col("_a1") != a, F.col("_o1") < now).otherwise(F.col("_o2") < now), F.lit(False))


def _probe(rows: DataFrame, address: str, block: str, pins: DataFrame, cps: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: an address of the same block, other than ``address``, was known before the row."""
    pin2 = _two_earliest(pins.groupBy("pay_to").agg(F.min(F.struct("ms", "seq")).alias("o")).select(
        F.col("pay_to").alias("address"), "o.ms", "o.seq").withColumn(block, block_key("address")).filter(F.col(block).isNotNull()), [block])
    cp2 = _two_earliest(cps.select("agent_key", F.col("pay_to").alias("address"), "ms", "seq")
                        .withColumn(block, block_key("address")).filter(F.col(block).isNotNull()), ["agent_key", block])
    d = rows.join(pin2, block, "left").withColumn("_by_pin", _other_known(address)).drop("_a1", "_a2", "_o1", "_o2")
    d = d.join(cp2, ["agent_key", block], "left").withColumn(name, F.col("_by_pin") | _other_known(address))
    return d.drop("_by_pin", "_a1", "_a2", "_o1", "_o2")


def trust_checks(rows: DataFrame, pins: DataFrame, cps: DataFrame) -> DataFrame:
    """Adds ``pin_pay_to, pin_ms, known_payee, lookalike, bait`` to rows with ``pay_to_lc, candidates``."""
    d = join_counterparties(join_pins(rows, pins), cps)
    exact = pins.groupBy(F.col("pay_to").alias("pay_to_lc")).agg(F.min(F.struct("ms", "seq")).alias("_o"))
    d = d.join(exact, "pay_to_lc", "left").withColumn("_exact", F.coalesce(F.col("_o") < order_of(), F.lit(False)) | F.col("known_payee")).drop("_o")
    d = d.withColumn("_block", block_key("pay_to_lc"))
    d = _probe(d, "pay_to_lc", "_block", pins, cps, "_near")
    d = d.withColumn("lookalike", F.col("_block").isNotNull() & F.col("_near") & ~F.col("_exact")).drop("_block", "_near", "_exact")
    # addresses written in content or offer; rows without any do not enter the join
    c = rows.filter(F.size("candidates") > 0).select("seq", "ms", "agent_key", "pay_to_lc", F.explode("candidates").alias("_cand"))
    c = _probe(c.withColumn("_cblock", block_key("_cand")), "_cand", "_cblock", pins, cps, "_hit")
    c = c.withColumn("_hit", F.col("_hit") | F.coalesce(is_lookalike("_cand", "pay_to_lc"), F.lit(False)))
    hit = c.filter("_hit").select("seq").distinct().withColumn("_bait", F.lit(True))
    return d.join(hit, "seq", "left").withColumn("bait", F.coalesce("_bait", F.lit(False))).drop("_bait")


def blocks_by_trust(pinning: bool = True) -> Column:
    mismatch = F.coalesce(F.col("pin_pay_to") != F.col("pay_to_lc"), F.lit(False)) if pinning else F.lit(False)
    return mismatch | F.col("lookalike") | (F.col("bait") & F.col("untrusted"))


def affected_rows(rows: DataFrame, pins: DataFrame | None, cps: DataFrame | None) -> DataFrame:
    """Rows whose verdict may depend on trust history (a closed set)."""
    seen = rows.filter(F.col("domain").isNotNull() & F.col("pay_to_lc").isNotNull()).select("domain", F.col("pay_to_lc").alias("a"))
    if pins is not None:
        seen = seen.unionByName(pins.select("domain", F.col("pay_to").alias("a")))
    domains = seen.groupBy("domain").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).filter("lo <> hi").select("domain")
    known = rows.select(F.col("pay_to_lc").alias("a"))
    for h in (pins, cps):
        if h is not None:
            known = known.unionByName(h.select(F.col("pay_to").alias("a")))
    known = known.withColumn("_block", block_key("a")).filter(F.col("_block").isNotNull())
    near = known.groupBy("_block").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).filter("lo <> hi").select("_block")
    written = rows.filter(F.size("candidates") > 0).select("seq", F.explode("candidates").alias("a")).select("seq", block_key("a").alias("_block"))
    watched = near.unionByName(written.select("_block")).distinct()
    d = rows.withColumn("_block", block_key("pay_to_lc"))
    d = d.join(domains.withColumn("_d", F.lit(True)), "domain", "left").join(watched.withColumn("_w", F.lit(True)), "_block", "left")
    keep = F.coalesce(F.col("_d"), F.lit(False)) | F.coalesce(F.col("_w"), F.lit(False)) | (F.size("candidates") > 0)
    return d.filter(keep).drop("_block", "_d", "_w")


LOOP_COLUMNS = ("seq", "ms", "direction", "agent_key", "pay_to_lc", "domain", "untrusted", "candidates", "static_block")


def resolve_blocks(rows: DataFrame, workspace: Workspace, *, pins: DataFrame | None = None, counterparties: DataFrame | None = None,
                   pinning: bool = True, max_rounds: int = 200) -> tuple[DataFrame, int]:
    """Final block decision of every affected row as ``seq, blocked, lookalike, bait``, and the number of rounds.

    ``rows`` carries LOOP_COLUMNS. Each round is written to the shared folder, so a lost executor costs one round at
    most. An answer that has not settled within ``max_rounds`` raises, it is never returned.
    """
    state = affected_rows(rows.select(*LOOP_COLUMNS), pins, counterparties).withColumn("blocked", F.col("static_block")).withColumn(
        "changed", F.lit(True))
    state = workspace.materialize(state, "trust-start")
    if state.isEmpty():
        return state.select("seq", "blocked", F.lit(False).alias("lookalike"), F.lit(False).alias("bait")), 0
    for n in range(1, max_rounds + 1):
        ok = state.filter(~F.col("blocked"))
        now = trust_checks(state.drop("lookalike", "bait"), derive_pins(ok, pins), derive_counterparties(ok, counterparties))
        now = now.withColumn("_new", F.col("static_block") | blocks_by_trust(pinning))
        now = now.select(*LOOP_COLUMNS, F.col("_new").alias("blocked"), (F.col("_new") != F.col("blocked")).alias("changed"),
                         "lookalike", "bait")
        state = workspace.materialize(now, f"trust-round-{n}")
        workspace.discard("trust-start" if n == 1 else f"trust-round-{n - 1}")
        if state.filter("changed").isEmpty():
            return state.select("seq", "blocked", "lookalike", "bait"), n
    raise RuntimeError(f"trust history did not settle within {max_rounds} rounds; raise max_rounds")


def _branchings(addresses: DataFrame) -> DataFrame:
    """``address, _pre, _suf``: the lengths from the front and from the back at which another address of the block (``_b``) leaves it.

    The addresses of a block that share a stem go on with different digits exactly when the least and the greatest of them do. So an
    aggregation with partial results finds the stems where a block branches, however many addresses it holds.
    """
    body = F.substring("address", 3, 40)
    sides = F.array(F.struct(F.lit(True).alias("front"), body.alias("t")), F.struct(F.lit(False).alias("front"), F.reverse(body).alias("t")))
    d = addresses.select("_b", "address", F.explode(sides).alias("_s")).select(
        "_b", "address", "_s.front", "_s.t", F.explode(F.sequence(F.lit(MIN_SHARED), F.lit(39))).alias("i"))
    d = d.withColumn("stem", F.substring("t", F.lit(1), F.col("i")))
    after = lambda c: F.substring(c, F.col("i") + 1, F.lit(1))
    stems = d.groupBy("_b", "front", "i", "stem").agg(F.min("t").alias("_lo"), F.max("t").alias("_hi")).filter(after("_lo") != after("_hi"))
    d = d.join(stems.select("_b", "front", "i", "stem"), ["_b", "front", "i", "stem"], "left_semi")
    return d.groupBy("address").agg(F.collect_list(F.when(F.col("front"), F.col("i"))).alias("_pre"),
                                    F.collect_list(F.when(~F.col("front"), F.col("i"))).alias("_suf"))


def near_address_best(probes: DataFrame, known: DataFrame, workspace: Workspace | None = None) -> DataFrame:
    """Best look-alike per probe: most shared digits, counterparties before pins, then the earliest.

    ``probes``: ``probe_id, pos, address, ms, seq, scope``; ``known``: ``scope, address, ms, seq, source`` (scope empty = everyone's).
    Two addresses part at a length where the block branches, from the front and from the back. So an address is filed under the pairs of
    its branching lengths only, and the two earliest addresses of a file tell whether another one was known before: a block of two
    addresses has one file, a flooded one about the square of the logarithm of its size per address, and none turns into all its pairs.
    """
    rank = F.when(F.col("source") == "payee", 0).when(F.col("source") == "counterparty", 1).otherwise(2)
    p = probes.withColumn("_b", block_key("address")).filter(F.col("_b").isNotNull())
    k = known.withColumn("_b", block_key("address")).filter(F.col("_b").isNotNull()).withColumn("_src", rank)
    seen = p.select("_b", "address", F.lit(True).alias("_asked")).unionByName(k.select("_b", "address", F.lit(False).alias("_asked")))
    seen = seen.groupBy("_b", "address").agg(F.max("_asked").alias("_asked"))
    contested = seen.groupBy("_b").agg(F.min("address").alias("_lo"), F.max("address").alias("_hi"), F.max("_asked").alias("_asked"))
    contested = contested.filter(F.col("_asked") & (F.col("_lo") != F.col("_hi"))).select("_b")
    workspace = Workspace(probes.sparkSession) if workspace is None else workspace
    lengths = workspace.materialize(_branchings(seen.join(contested, "_b", "left_semi")), "branchings")

    def filed(d):
        body = F.substring("address", 3, 40)
        pairs = F.flatten(F.transform("_pre", lambda i: F.transform(F.filter("_suf", lambda j: i + j < 40), lambda j: F.struct(i.alias("i"), j.alias("j")))))
        d = d.join(lengths, "address").withColumn("_ij", F.explode(pairs)).drop("_pre", "_suf")
        return d.withColumn("_n", F.col("_ij.i") + F.col("_ij.j")).withColumn("_file", F.concat_ws(
            "|", F.col("_ij.i"), F.substring(body, F.lit(1), F.col("_ij.i")), F.right(body, F.col("_ij.j")))).drop("_ij")

    files = _two_earliest(filed(k.select("scope", "_src", "address", "ms", "seq")), ["scope", "_src", "_file"])
    m = filed(p.select("probe_id", "pos", "address", "ms", "seq", "scope"))
    m = m.withColumn("scope", F.explode(F.array_distinct(F.array(F.coalesce("scope", F.lit("")), F.lit(""))))).join(files, ["scope", "_file"])
    other = F.when(F.col("_a1") != F.col("address"), F.struct(F.col("_a1").alias("a"), F.col("_o1").alias("o"))).otherwise(
        F.struct(F.col("_a2").alias("a"), F.col("_o2").alias("o")))
    m = m.withColumn("_m", other).filter(F.col("_m.a").isNotNull() & (F.col("_m.o") < order_of()))
    best = m.groupBy("probe_id", "pos", "address").agg(F.min(F.struct((-F.col("_n")).alias("n"), "_src", F.col("_m.o").alias("o"), F.col("_m.a").alias("a"))).alias("b"))
    return best.select("probe_id", "pos", "address", F.col("b.a").alias("similar_to"),
                       F.when(F.col("b._src") == 1, "counterparty").when(F.col("b._src") == 0, "payee").otherwise("pin").alias("similar_source"),
                       shared_prefix("address", "b.a").alias("shared_prefix"), shared_suffix("address", "b.a").alias("shared_suffix"))


def best_lookalike(found: DataFrame) -> DataFrame:
    """One row per probe_id out of several probed addresses: most shared digits first."""
    source = F.when(F.col("similar_source") == "payee", 0).when(F.col("similar_source") == "counterparty", 1).otherwise(2)
    w = W.partitionBy("probe_id").orderBy(F.desc(F.col("shared_prefix") + F.col("shared_suffix")), "pos", source)
    return found.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def pin_directory_status(pins: DataFrame, directory: DataFrame) -> DataFrame:
    """Adds ``directory_status`` to pins: verified, mismatch, or unchecked where the payee is not listed.

    ``directory`` holds ``pay_to, domain`` (one row per registered resource host).
    """
    d = directory.select(F.lower("pay_to").alias("pay_to"), "domain").filter(F.col("domain").isNotNull()).distinct()
    listed = d.select("pay_to").distinct().withColumn("_listed", F.lit(True))
    here = d.withColumn("_here", F.lit(True))
    j = pins.join(listed, "pay_to", "left").join(here, ["pay_to", "domain"], "left")
    return j.withColumn("directory_status", F.when(F.col("_here"), "verified").when(F.col("_listed"), "mismatch").otherwise("unchecked")).drop("_listed", "_here")


def with_pin_evidence(rows: DataFrame, pins: DataFrame) -> DataFrame:
    """Pin evidence when the pin is for this payee: ``pin_domain, pin_age_seconds, pin_corroboration`` (a row's own pin has age 0)."""
    status = F.col("directory_status") if "directory_status" in pins.columns else F.lit("unchecked")
    p = pins.select("domain", F.col("pay_to").alias("_p"), F.struct("ms", "seq").alias("_o"), status.alias("_s"))
    d = rows.join(p, "domain", "left")
    mine = (F.col("_p") == F.col("pay_to_lc")) & (F.col("_o") <= order_of())
    return (d.withColumn("pin_domain", F.when(mine, F.col("domain")))
            .withColumn("pin_age_seconds", F.when(mine, F.greatest(F.lit(0), F.floor((F.col("ms") - F.col("_o.ms")) / 1000)).cast("bigint")))
            .withColumn("pin_corroboration", F.when(mine, F.when(F.col("_s") == "verified", "cdp_bazaar").otherwise("none")))
            .drop("_p", "_o", "_s"))


def other_addresses(candidates, payee) -> Column:
    """Candidate addresses without the payee's own."""
    return F.filter(F.array_distinct(col(candidates)), lambda a: ~a.eqNullSafe(col(payee)))
