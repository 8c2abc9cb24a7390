"""Admission of a whole batch of invitations in its order, under the rolling caps.

Within a batch each command sees what the ones before it left behind: only invitations that were
written count towards the caps, a person one command adds is known to the next, and an invitation one
command opens is found by the next. Judging all commands against the same state, as
:func:`commands.invite` does, would let any number through.

At one clock counts only grow, and the cap over all organizations bounds what a batch can write
(``GLOBAL_CAP``). So the order is settled in waves: each wave asks, in one parallel pass, for the first
commands that could still write after what is already written, and takes those that do not stand in each
other's way. It ends when no command could write. All other commands, any number, are then judged in one
pass beside the few that wrote. Every wave writes something or is the last, so there are at most as many
waves as the cap allows writes, whatever the size of the batch.

Waves go through the first commands of the batch before they go through all of it, since a large batch
fills the cap over all organizations early. A command after that place is refused by a cap whomever it
invites, so persons, accounts and open invitations are looked up for those before it alone, once.

All commands meet the rights of their (organization, actor), but few need travel for that: the pairs that
have rights are written down once, and a bit filter of them tells most other commands apart where they are
read. What passes is exchanged, with the columns that its outcome still depends on. The filter only spares
the exchange; the join decides."""

from __future__ import annotations

from collections import Counter
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, functions as F, types as T

from docwarden.functions import validation as V
from docwarden.functions.temporal import at, days
from docwarden.functions.text import stable_id
from docwarden.operators import caps
from docwarden.operators.access import INVITERS, AccessState, authority, invitation_is_open
from docwarden.operators.commands import (
    ACCOUNT_NEEDED, CHECK, INPUT, MAX_GRANT_DAYS, PRIVILEGE, gate_rules, refusal_of,
)
from docwarden.sources.tables import written_alone as stored

#: Commands that one wave looks at.
WAVE = 64
#: The first commands that rights do not refuse are looked at in so many blocks of so many, before all that are left.
BLOCKS, BLOCK = 4, 8192
#: Bits of the filter of known pairs (16 MB, whatever the input), and of one part of it (by bitmap_construct_agg).
BITS, PART = 1 << 27, 1 << 15

_WRITE = T.StructType([
    T.StructField(n, t) for n, t in (
        ("place", T.StructType([T.StructField("seq", T.StringType()), T.StructField("command_id", T.StringType())])),
        ("org_id", T.StringType()), ("actor", T.StringType()), ("role", T.StringType()), ("email", T.StringType()), ("account", T.StringType()),
        ("user_id", T.StringType()), ("new_user", T.BooleanType()), ("invitation_id", T.StringType()), ("moved_from", T.StringType()),
    )
])


def admit(commands: DataFrame, state: AccessState, as_of) -> DataFrame:
    """``commands(seq, command_id, actor, org_id, email, role, display_name, account_id)``, judged one
    after another by ``seq`` (then ``command_id``), all at ``as_of``.

    Adds the columns of :func:`commands.invite`: ``accepted``, the refusal, ``invited_email``, ``result``
    (``created``, ``renewed``; ``existing`` writes nothing), ``invitation_id``, ``invited_user_id``,
    ``new_user``, ``expires_at``. Commands without a ``seq`` come first."""
    recent = _recent(state, as_of)
    known = stored(_known(state, recent), "known")
    bits = stored(_bits(known), "bits")
    placed = _with_repeated(commands, state.users).withColumns({
        "_place": F.struct(F.col("seq").cast("string").alias("seq"), F.col("command_id").cast("string").alias("command_id")),
        "invited_email": V.normalized_email(F.coalesce("email", F.lit(""))), "_account": F.lower("account_id"),
        "_org": F.when(V.valid_role(F.col("role")), F.col("org_id")),
    })
    written, facts = _settled(placed, known, bits, state, recent, as_of)
    late = _late(written, recent[2])
    late = F.lit(False) if late is None else late
    judged = _judged(facts.where(~late), written, as_of)
    outcome = ("result", "invitation_id", "invited_user_id", "new_user", "expires_at")
    columns = [*commands.columns, "invited_email", "_refusal", *(f"_{c}" for c in outcome)]
    nothing = {f"_{c}": F.lit(None).cast(judged.schema[f"_{c}"].dataType) for c in outcome}
    judged = judged.select(*columns)
    marked = placed.withColumn("_late", late)
    for rows, rights in _dealt(marked, _full(known, recent, written), bits):
        gated = _gated(rows, rights).withColumn("_refusal", F.coalesce("_early", F.when(F.col("_late"), refusal_of([
            (F.col("_org_full"), *caps.REFUSALS["org"]), (F.col("_sender_full"), *caps.REFUSALS["sender"]), (F.lit(True), *caps.REFUSALS["global"])]))))
        judged = judged.unionByName(gated.where(F.col("_refusal").isNotNull()).withColumns(nothing).select(*columns))
    return judged.select(
        *commands.columns, F.col("_refusal").isNull().alias("accepted"), F.col("_refusal.code").alias("refusal_code"),
        F.col("_refusal.reason").alias("refusal_reason"), "invited_email", *(F.when(F.col("_refusal").isNull(), F.col(f"_{c}")).alias(c) for c in outcome),
    )


def _recent(state: AccessState, as_of) -> tuple[DataFrame, DataFrame, int]:
    """Invitations of the last day by organization, by sender and overall, written so that joins know how few there are."""
    by_org = caps.recent_counts(state.invitations, as_of, "org_id").withColumnRenamed("recent", "_org_recent")
    by_sender = caps.recent_counts(state.invitations, as_of, "invited_by").select(F.col("invited_by").alias("actor"), F.col("recent").alias("_sender_recent"))
    by_org = stored(by_org, "recent-org")
    return by_org, stored(by_sender, "recent-sender"), by_org.agg(F.coalesce(F.sum("_org_recent"), F.lit(0))).first()[0]


def _able() -> Column:
    """Whether a person is enabled and no platform admin."""
    active = F.col("disabled_at").isNull()
    return active & ~F.coalesce(active & F.col("is_platform_admin"), F.lit(False))


def _known(state: AccessState, recent: tuple) -> DataFrame:
    """The pairs of organization and person that may invite, and the persons that are able to do anything, with no
    organization: a command whose role is unknown is refused by its person alone. Each comes once."""
    zero, no = F.lit(0).cast("long"), F.lit(False)
    rights = authority(state, INVITERS).join(recent[0], "org_id", "left").join(recent[1].withColumnRenamed("actor", "user_id"), "user_id", "left").select(
        F.col("org_id").alias("_known_org"), F.col("user_id").alias("_known_person"), "is_admin", "is_inviter",
        F.coalesce("_org_recent", zero).alias("_org_recent"), F.coalesce("_sender_recent", zero).alias("_sender_recent"))
    people = state.users.where(_able() & F.col("user_id").isNotNull()).select("user_id").distinct().select(
        F.lit(None).cast("string").alias("_known_org"), F.col("user_id").alias("_known_person"), no.alias("is_admin"), no.alias("is_inviter"),
        zero.alias("_org_recent"), zero.alias("_sender_recent"))
    return rights.unionByName(people)


def _with_repeated(commands: DataFrame, users: DataFrame) -> DataFrame:
    """A command comes once for each of its actor's rows. Only persons that come more than once are joined for
    that, if there are any; ``_able`` is theirs."""
    rows = users.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.collect_list(_able()).alias("_rows")).where(F.size("_rows") > 1)
    repeated = stored(rows.select(F.col("user_id").alias("_repeated"), F.explode("_rows").alias("_able")), "repeated")
    if repeated.isEmpty():
        return commands.withColumn("_able", F.lit(None).cast("boolean"))
    return commands.join(repeated, F.col("actor") == F.col("_repeated"), "left").select(*commands.columns, "_able")


def _bit(org: str, person: str) -> Column:
    return F.xxhash64(org, person).bitwiseAND(F.lit(BITS - 1))


def _bits(known: DataFrame) -> DataFrame:
    """The bit filter of ``known``, in parts."""
    place = known.select((_bit("_known_org", "_known_person") + 1).alias("place"))
    return place.groupBy(F.bitmap_bucket_number("place").alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("_bits"))


def _dealt(placed: DataFrame, known: DataFrame, bits: DataFrame) -> list[tuple[DataFrame, DataFrame | None]]:
    """The commands whose pair is not known, which need no join, and those whose pair may be, with ``known``."""
    bit = _bit("_org", "actor")
    at_bit = bit.bitwiseAND(F.lit(PART - 1)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(at_bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), at_bit.bitwiseAND(F.lit(7)))) != 0
    tested = placed.join(F.broadcast(bits), F.floor(bit / PART) + 1 == F.col("_part"), "left").withColumn(
        "_maybe", F.coalesce(F.col("actor").isNotNull() & is_set, F.lit(False)))
    return [(tested.where("not _maybe").select(*placed.columns), None), (tested.where("_maybe").select(*placed.columns), known)]


def _gated(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """Adds ``_early``, the refusal that depends on actor, organization and role alone, and what ``known`` says of the pair."""
    if known is None:
        facts = {c: F.lit(None).cast(t) for c, t in (("_known_person", "string"), ("is_admin", "boolean"), ("is_inviter", "boolean"), ("_org_full", "boolean"), ("_sender_full", "boolean"))}
        j = rows.withColumns(facts)
    else:
        j = rows.join(known, F.col("_org").eqNullSafe(F.col("_known_org")) & (F.col("actor") == F.col("_known_person")), "left")
    no = F.lit(False)
    flags = j.withColumns({
        "_me_active": F.coalesce("_able", F.col("_known_person").isNotNull()), "_me_platform": no,
        "_me_admin": F.coalesce("is_admin", no), "_me_inviter": F.coalesce("is_inviter", no),
    })
    return flags.withColumn("_early", refusal_of(gate_rules()[:-3]))


def _full(known: DataFrame, recent: tuple, written: list[Row]) -> DataFrame:
    """``known`` with what the caps of organization and sender say after all of the batch is written."""
    by_org = Counter(w["org_id"] for w in written if w["moved_from"] is None)
    by_sender = Counter(w["actor"] for w in written)
    by_sender.subtract(w["moved_from"] for w in written if w["moved_from"] is not None)

    def added(counts: Counter, key: str) -> Column:
        if not counts:
            return F.lit(0)
        return F.coalesce(F.create_map(*(F.lit(x) for pair in counts.items() for x in pair))[F.col(key)], F.lit(0))

    return known.select(
        "_known_org", "_known_person", "is_admin", "is_inviter", (F.col("_org_recent") + added(by_org, "_known_org") >= caps.ORG_CAP).alias("_org_full"),
        (F.col("_sender_recent") + added(by_sender, "_known_person") >= caps.SENDER_CAP).alias("_sender_full"))


def _fit(rows: DataFrame, known: DataFrame, recent: tuple) -> DataFrame:
    """The commands that are not refused early, with the counts before the batch."""
    fit = _gated(rows, known).where(F.col("_early").isNull())
    return stored(fit.select(*rows.columns, "_org_recent", "_sender_recent", F.lit(recent[2]).cast("long").alias("_all_recent"), "_early"), "fit")


def _of_same_pairs(known: DataFrame, commands: DataFrame) -> DataFrame:
    pairs = commands.select("_org", "actor").distinct()
    return known.join(pairs, F.col("_known_org").eqNullSafe(F.col("_org")) & (F.col("_known_person") == F.col("actor")), "left_semi")


def _of_same_organizations(rows: DataFrame, commands: DataFrame) -> DataFrame:
    return rows.join(commands.select("org_id").distinct(), "org_id", "left_semi")


def _facts(fit: DataFrame, state: AccessState, as_of) -> DataFrame:
    """Person, account and open invitation of each command, which do not depend on the rest of the batch."""
    people = state.users.select(F.col("email").alias("invited_email"), F.col("user_id").alias("_target"))
    accounts = state.users.select(F.col("cognito_sub").alias("_account"), F.lit(True).alias("_account_taken"))
    mine = state.users.select(F.col("user_id").alias("actor"), F.col("email").alias("_my_email"))
    opened = _of_same_organizations(state.invitations.where(invitation_is_open()), fit).groupBy("org_id", F.col("invited_user_id").alias("_target"), "role").agg(
        F.max_by(F.struct("invitation_id", "expires_at", "invited_at", "invited_by"), F.struct("invited_at", "invitation_id")).alias("_open"))
    j = fit.join(people, "invited_email", "left").join(mine, "actor", "left").join(accounts, "_account", "left").join(opened, ["org_id", "_target", "role"], "left")
    wrong_input = [
        (~V.valid_email(F.col("invited_email")), INPUT, "that is not a valid email address"),
        (~V.valid_display_name(F.col("display_name"), V.CONTROL), INPUT, "that name is not acceptable"),
        (F.col("invited_email") == F.col("_my_email"), PRIVILEGE, "you cannot invite yourself"),
    ]
    return j.select(
        *fit.columns, "_target", "_open",
        F.coalesce(F.btrim("account_id") == "", F.lit(True)).alias("_no_account"), F.coalesce(F.col("_account").rlike(V.UUID), F.lit(False)).alias("_account_valid"),
        F.coalesce("_account_taken", F.lit(False)).alias("_account_taken"), refusal_of(wrong_input).alias("_wrong"),
        F.coalesce(F.col("_open.invited_at") > at(as_of) - F.expr(f"INTERVAL {caps.CAP_HOURS} HOUR"), F.lit(False)).alias("_open_recent"),
    )


def _after(place) -> Column:
    return F.struct(F.lit(place["seq"]).cast("string").alias("seq"), F.lit(place["command_id"]).cast("string").alias("command_id"))


def _late(written: list[Row], recent: int) -> Column | None:
    """Whether a command comes when the cap over all organizations is full; None if it does not fill."""
    counted = [w for w in written if w["moved_from"] is None]
    if recent >= caps.GLOBAL_CAP:
        return F.lit(True)
    return F.col("_place") > _after(counted[caps.GLOBAL_CAP - recent - 1]["place"]) if len(counted) >= caps.GLOBAL_CAP - recent else None


def _settled(placed: DataFrame, known: DataFrame, bits: DataFrame, state: AccessState, recent: tuple, as_of) -> tuple[list[Row], DataFrame]:
    """The commands that write, in order, and the facts of all that rights do not refuse, up to where the cap over
    all is full at least. Block by block from the first commands, then from all others."""
    written: list[Row] = []
    found: list[DataFrame] = []

    def settle(fit: DataFrame, state: AccessState) -> bool:
        nonlocal written
        found.append(stored(_facts(fit, state, as_of), "facts"))
        written = _written(found[-1], written, as_of)
        return _late(written, recent[2]) is not None

    def blocks() -> DataFrame | None:
        """What is left after the blocks, if anything can still write."""
        rest, many = placed, BLOCKS * BLOCK
        for _ in range(BLOCKS):
            window = stored(rest.orderBy("_place").limit(many), "window")
            last = window.agg(F.count("*").alias("n"), F.max("_place").alias("place")).first()
            if last["n"] == many:  # more commands may have the last place
                window = window.where(F.col("_place") < _after(last["place"]))
            fit = _fit(window, _of_same_pairs(known, window), recent)
            near = replace(state, invitations=stored(_of_same_organizations(state.invitations.where(invitation_is_open()), fit), "open"))
            left = fit
            while (end := left.orderBy("_place").limit(BLOCK).agg(F.max("_place").alias("place")).first()["place"]) is not None:
                if settle(left.where(F.col("_place") <= _after(end)), near):
                    return None
                left = fit.where(F.col("_place") > _after(end))
                if len(found) == BLOCKS:
                    return placed.where(F.col("_place") > _after(end))
            if last["n"] < many:
                return None
            rest = placed.where(F.col("_place") >= _after(last["place"]))
        return rest

    if _late(written, recent[2]) is None:
        rest = blocks()
        if rest is not None:
            settle(_fit(*_dealt(rest, known, bits)[1], recent), state)
    if not found:
        none = placed.where(F.lit(False))
        found.append(_facts(_fit(none, _of_same_pairs(known, none), recent), state, as_of))
    return written, reduce(DataFrame.unionByName, found)


def _literal(written: list[Row]) -> Column:
    def value(v, kind):
        if isinstance(kind, T.StructType):
            return F.struct(*(value(v[f.name], f.dataType).alias(f.name) for f in kind))
        return F.lit(v).cast(kind)

    return F.array(*(value(w, _WRITE) for w in written)).cast(T.ArrayType(_WRITE))


def _judged(facts: DataFrame, written: list[Row], as_of) -> DataFrame:
    """Each command after those of ``written`` that come before it: its refusal and its outcome."""
    now, all_written = at(as_of), _literal(written)
    before = F.filter(all_written, lambda w: w["place"] < F.col("_place"))
    j = facts.withColumn("_before", F.when(F.col("_early").isNull(), before))

    def number(condition) -> Column:
        return F.size(F.filter("_before", condition))

    # A renewed invitation of the last day moves from its old sender to the new one.
    still = lambda w: w["moved_from"].isNull()
    added = F.get(F.filter("_before", lambda w: w["new_user"] & (w["email"] == F.col("invited_email"))), F.lit(0))["user_id"]
    j = j.withColumns({
        "_org_n": F.col("_org_recent") + number(lambda w: (w["org_id"] == F.col("org_id")) & still(w)),
        "_sender_n": F.col("_sender_recent") + number(lambda w: w["actor"] == F.col("actor")) - number(lambda w: w["moved_from"] == F.col("actor")),
        "_all_n": F.col("_all_recent") + number(still),
        "_known": F.coalesce("_target", added),
        "_taken": F.col("_account_taken") | F.exists("_before", lambda w: w["new_user"] & (w["account"] == F.col("_account"))),
    })
    same = F.filter("_before", lambda w: (w["org_id"] == F.col("org_id")) & (w["user_id"] == F.col("_known")) & (w["role"] == F.col("role")))
    unknown = F.col("_known").isNull()
    refusal = F.coalesce("_early", refusal_of([
        (F.col("_org_n") >= caps.ORG_CAP, *caps.REFUSALS["org"]), (F.col("_sender_n") >= caps.SENDER_CAP, *caps.REFUSALS["sender"]),
        (F.col("_all_n") >= caps.GLOBAL_CAP, *caps.REFUSALS["global"]),
    ]), "_wrong", refusal_of([
        (unknown & F.col("_no_account"), ACCOUNT_NEEDED, "account_needed"), (unknown & ~F.col("_account_valid"), INPUT, "invalid account id"),
        (unknown & F.col("_taken"), CHECK, "that account could not be set up"),
    ]))
    j = j.withColumns({"_refusal": refusal, "_ours": F.get(same, F.lit(0))["invitation_id"]})
    live = F.col("_ours").isNotNull() | F.coalesce(F.col("_open.expires_at") > now, F.lit(False))
    opens = now + days(MAX_GRANT_DAYS)
    return j.withColumns({
        "_result": F.when(live, "existing").when(F.col("_open").isNull(), "created").otherwise("renewed"),
        "_invitation_id": F.coalesce("_ours", "_open.invitation_id", stable_id(F.lit("invitation"), F.col("command_id").cast("string"))),
        "_invited_user_id": F.coalesce("_known", stable_id(F.lit("user"), F.col("_account"))),
        "_new_user": unknown,
        "_expires_at": F.when(live & F.col("_ours").isNull(), F.col("_open.expires_at")).otherwise(opens),
        "_moved_from": F.when(F.col("_open_recent"), F.col("_open.invited_by")),
    })


def _written(facts: DataFrame, before: list[Row], as_of) -> list[Row]:
    """``before`` and the commands of ``facts``, which come after them, that write, in order. At most
    ``GLOBAL_CAP`` of all can, except that a renewal within a day of its first sending takes no new place;
    such a one ends its wave."""
    written = list(before)
    after = None
    while True:
        could = _judged(facts, written, as_of).where(F.col("_refusal").isNull() & (F.col("_result") != "existing"))
        if after is not None:
            could = could.where(F.col("_place") > _after(after))
        rows = could.orderBy("_place").select(
            F.col("_place").alias("place"), "org_id", "actor", "role", F.col("invited_email").alias("email"), F.col("_account").alias("account"),
            F.col("_invited_user_id").alias("user_id"), F.col("_new_user").alias("new_user"), F.col("_invitation_id").alias("invitation_id"),
            F.col("_moved_from").alias("moved_from"), "_org_n", "_sender_n", "_all_n",
        ).limit(WAVE).collect()
        taken, settled = _taken(rows)
        written += taken
        if not rows or (settled and len(rows) < WAVE):
            return written
        after = rows[-1]["place"] if settled else taken[-1]["place"]


def _taken(rows: list[Row]) -> tuple[list[Row], bool]:
    """Of one wave's commands in order, each fit to write on its own, those that write together; and
    whether the others of the wave are settled as well. A new person or a moved invitation can open the
    way for later commands, so the next wave starts behind it."""
    by_org, by_sender, everywhere, keys, taken = Counter(), Counter(), 0, set(), []
    for r in rows:
        key = (r["org_id"], r["user_id"], r["role"])
        full = (
            r["_org_n"] + by_org[r["org_id"]] >= caps.ORG_CAP or r["_sender_n"] + by_sender[r["actor"]] >= caps.SENDER_CAP
            or r["_all_n"] + everywhere >= caps.GLOBAL_CAP
        )
        if full or key in keys:
            continue
        taken.append(r)
        if r["new_user"] or r["moved_from"] is not None:
            return taken, False
        keys.add(key)
        by_org[r["org_id"]] += 1
        by_sender[r["actor"]] += 1
        everywhere += 1
    return taken, True
