"""Payment events, subscriptions, revenue and access.

Raw events: delivery_id, received_at, payload (JSON text), result, error_detail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausedelta import schemas
from clausedelta.functions.segments import segmented_last
from clausedelta.functions.stages import with_computed
from clausedelta.functions.text import non_blank

# Event types and the subscription status each one sets.
EVENT_STATUS = {
    "BILLING.SUBSCRIPTION.ACTIVATED": "active",
    "BILLING.SUBSCRIPTION.CANCELLED": "cancelled",
    "BILLING.SUBSCRIPTION.SUSPENDED": "suspended",
    "BILLING.SUBSCRIPTION.EXPIRED": "expired",
    "PAYMENT.SALE.COMPLETED": "active",
}
TRIAL_DAYS = 14
CODE_MINUTES = 15
GRACE_SECONDS = 172_800


def utc_time(text: Column) -> Column:
    """Time of an ISO text in UTC, whatever the session's zone; a text without a zone is in UTC."""
    day = F.when(text.rlike(r"^\s*\d{4}-\d\d-\d\d\s*$"), F.concat(F.trim(text), F.lit("T00:00:00"))).otherwise(F.trim(text))
    zoned = F.when(day.rlike(r"(?:[zZ]|[+-]\d\d:?\d\d|[A-Z]{3})$"), day).otherwise(F.concat(day, F.lit("Z")))
    micros = F.unix_micros(F.try_to_timestamp(zoned))
    seconds = (micros.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def normalize_events(raw: DataFrame, own_id_first: bool = False) -> DataFrame:
    """Typed columns of payment events; row-wise, so also for streams.

    A sale carries its own id; unless ``own_id_first`` is set, the
    agreement it belongs to is its subscription.
    """
    df = with_computed(raw, _p=F.from_json("payload", schemas.PAYMENT_PAYLOAD))
    kind, res = F.coalesce(F.col("_p.event_type"), F.lit("")), F.col("_p.resource")
    table = F.create_map(*[F.lit(x) for pair in EVENT_STATUS.items() for x in pair])
    own, agreement = non_blank(res["id"]), non_blank(res["billing_agreement_id"])
    subscription = F.coalesce(own, agreement)
    if not own_id_first:
        subscription = F.when(F.startswith(kind, F.lit("PAYMENT.SALE")), F.coalesce(agreement, own)).otherwise(subscription)
    person = res["subscriber"]["name"]
    name = F.trim(F.concat_ws(" ", non_blank(person["given_name"]), non_blank(person["surname"])))
    amount = res["amount"]
    return df.select(
        *raw.columns,
        F.col("_p.id").alias("event_id"),
        kind.alias("event_type"),
        F.coalesce(F.try_element_at(table, kind), F.lit("unknown")).alias("status"),
        subscription.alias("subscription_id"),
        res["subscriber"]["email_address"].alias("email"),
        F.coalesce(non_blank(name), non_blank(res["subscriber"]["business_name"])).alias("subscriber_name"),
        utc_time(res["billing_info"]["next_billing_time"]).alias("next_billing_at"),
        res["plan_id"].alias("plan_id"),
        F.coalesce(non_blank(amount["total"]), non_blank(amount["value"])).try_cast("decimal(12,2)").alias("amount"),
        F.coalesce(non_blank(amount["currency"]), non_blank(amount["currency_code"])).alias("currency"),
    )


def dedupe_events(events: DataFrame) -> DataFrame:
    """One row per event_id: data of the first delivery, outcome of the last.

    Events without an id are all kept. Partial aggregation folds redeliveries
    of a popular id before the shuffle.
    """
    rest = [c for c in events.columns if c not in ("event_id", "result", "error_detail")]
    order = F.struct("received_at", "delivery_id")
    group = F.coalesce(F.concat(F.lit("e"), F.col("event_id")), F.concat(F.lit("d"), F.col("delivery_id").cast("string")))
    folded = events.withColumn("_group", group).groupBy("_group").agg(
        F.min_by(F.struct("event_id", *rest), order).alias("d"),
        F.max_by(F.struct("result", "error_detail"), order).alias("r"),
        F.count("*").alias("deliveries"),
    )
    return folded.select("d.*", "r.*", "deliveries")


def stored_payload(payload: Column, most: int | None = None) -> Column:
    """Payload as it is stored, cut to ``most`` characters if asked for; text that does not parse reads as {}."""
    cut = payload if most is None else F.left(payload, F.lit(most))
    return F.when(F.try_parse_json(cut).isNotNull(), cut).otherwise("{}")


def default_next_billing(events: DataFrame) -> DataFrame:
    """Fill a missing billing date of active events from the plan's interval."""
    plan = F.lower(F.coalesce("plan_id", F.lit("")))
    yearly = F.contains(plan, F.lit("annual")) | F.contains(plan, F.lit("4ks"))
    days = F.when(yearly, F.expr("INTERVAL 365 DAYS")).otherwise(F.expr("INTERVAL 30 DAYS"))
    guess = F.when(F.col("status").isin("active", "completed"), F.col("received_at") + days)
    return events.withColumn("next_billing_at", F.coalesce("next_billing_at", guess))


def fold_subscriptions(events: DataFrame) -> DataFrame:
    """Current state per subscription: the last status, and of every other field
    the last value that is not null. Works on batches and on streams."""
    order = "struct(received_at, delivery_id)"
    last = lambda c: F.expr(f"max_by({c}, {order}) FILTER (WHERE {c} IS NOT NULL)").alias(c)
    return (
        events.where("subscription_id IS NOT NULL")
        .groupBy("subscription_id")
        .agg(
            F.expr(f"max_by(status, {order})").alias("status"),
            last("email"), last("subscriber_name"), last("plan_id"), last("next_billing_at"),
            F.min("received_at").alias("created_at"),
            F.max("received_at").alias("updated_at"),
        )
    )


def _with_plan(subscriptions: DataFrame, plans: DataFrame, how: str) -> DataFrame:
    # The catalogue is a short price list; Spark broadcasts it when its size allows.
    priced = plans.select(
        F.col("id").alias("plan"), F.col("name").alias("plan_name"), F.col("price").alias("plan_price"),
        F.col("interval").alias("plan_interval"), F.col("provider_plan_id").alias("plan_id"),
    )
    return subscriptions.join(priced, "plan_id", how)


def subscriber_list(subscriptions: DataFrame, plans: DataFrame) -> DataFrame:
    """All subscribers with their plan, newest first."""
    return _with_plan(subscriptions, plans, "left").select(
        "subscription_id",
        F.coalesce(non_blank(F.col("subscriber_name")), non_blank(F.col("email")), F.lit("Unknown subscriber")).alias("name"),
        "email", "status", "next_billing_at", "created_at", "plan",
        F.coalesce("plan_name", F.lit("Unrecognised plan")).alias("plan_name"),
        "plan_price", "plan_interval",
    ).orderBy(F.desc("created_at"), "subscription_id")


def plan_counts(subscriptions: DataFrame, plans: DataFrame) -> DataFrame:
    """Every plan with its number of active subscribers."""
    active = subscriptions.where("status = 'active'").groupBy("plan_id").agg(F.count("*").alias("subscribers"))
    return plans.join(active, plans["provider_plan_id"] == active["plan_id"], "left").select(
        "id", "name", "price", "interval", "provider_plan_id", "is_active",
        F.coalesce("subscribers", F.lit(0)).alias("subscribers"),
    )


def public_plans(plans: DataFrame) -> DataFrame:
    return plans.where(F.coalesce("is_active", F.lit(True))).select("id", "name", "price", "interval")


def revenue(subscriptions: DataFrame, plans: DataFrame) -> DataFrame:
    """Monthly and yearly recurring revenue of active subscribers on known plans.

    Subscribers are counted per plan first, so the sum runs over the plans.
    """
    counts = subscriptions.where("status = 'active'").groupBy("plan_id").agg(F.count("*").alias("n"))
    yearly = _with_plan(counts, plans, "inner").select(
        (F.when(F.col("plan_interval") == "year", F.col("plan_price")).otherwise(F.col("plan_price") * 12)
         * F.col("n").cast("decimal(18,0)")).cast("decimal(38,6)").alias("v")
    )
    total = F.coalesce(F.sum("v"), F.lit(0).cast("decimal(38,6)"))
    return yearly.agg(
        F.round((total / 12).cast("decimal(38,12)"), 2).cast("double").alias("mrr"),
        F.round(total, 2).cast("double").alias("arr"),
    )


def subscriber_buckets(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("status").isin("past_due", "suspended")).alias("past_due"),
        F.count_if(F.col("status").isin("cancelled", "expired")).alias("cancelled"),
    )


def access_status(requests: DataFrame, users: DataFrame, subscriptions: DataFrame, at: str) -> DataFrame:
    """Access decision per requested user at time ``at``.

    ``requests``: user_ref (an email or a user id, may be null). Users: id,
    email, is_active, is_verified, trial_ends_at (ISO text or null).
    """
    now = F.lit(at).cast("timestamp_ntz")
    qualifying = subscriptions.where(F.col("status").isin("active", "completed") & F.col("email").isNotNull())
    best = qualifying.groupBy(F.lower("email").alias("_email")).agg(
        F.max_by(F.struct("subscription_id", "plan_id", "next_billing_at"), F.struct("updated_at", "subscription_id")).alias("sub")
    )
    # A user can be named by email or by id; the email is tried first.
    known = users.select(F.lower(F.trim("email")).alias("_email"), F.struct(*users.columns).alias("user"))
    names = known.select(F.explode(F.array(
        F.struct(F.concat(F.lit("e"), "_email").alias("ref"), "user"),
        F.struct(F.concat(F.lit("i"), F.col("user.id").cast("string")).alias("ref"), "user"),
    )).alias("n")).select("n.*")
    one_name = names.where("ref is not null").groupBy("ref").agg(F.min_by("user", F.col("user.id").cast("string")).alias("user"))
    by_email, by_id = (one_name.select(F.col("ref").alias(f"_{x}"), F.col("user").alias(f"_by_{x}")) for x in "ei")
    wanted = requests.select("user_ref").withColumns({
        "_e": F.concat(F.lit("e"), F.lower(F.trim("user_ref"))), "_i": F.concat(F.lit("i"), F.trim("user_ref")),
    })
    found = wanted.join(by_email, "_e", "left").join(by_id, "_i", "left").withColumn("user", F.coalesce("_by_e", "_by_i"))
    df = found.withColumn("_email", F.lower(F.trim("user.email"))).join(best, "_email", "left")
    ends = utc_time(F.col("user.trial_ends_at"))
    grace = F.expr(f"INTERVAL '{GRACE_SECONDS}' SECOND")
    late = F.coalesce(now > F.col("sub.next_billing_at") + grace, F.lit(False))
    reason = (
        F.when(F.coalesce("user_ref", F.lit("")) == "", "unauthenticated")
        .when(F.col("user").isNull(), "user_not_found")
        .when(~F.coalesce("user.is_active", F.lit(True)), "account_disabled")
        .when(~F.coalesce("user.is_verified", F.lit(False)), "unverified")
        .when(ends > now, "trial")
        .when(F.col("sub").isNotNull() & ~late, "active_subscription")
        .otherwise("trial_expired")
    )
    df = df.withColumn("reason", reason)
    whole = F.datediff(ends, now)  # of calendar days; a later hour on the last day is another day begun
    days = whole + F.when(ends > now + F.make_dt_interval(whole), 1).otherwise(0)
    paid = F.col("reason") == "active_subscription"
    return df.select(
        "user_ref", F.col("user.id").alias("user_id"), "reason",
        F.col("reason").isin("trial", "active_subscription").alias("has_access"),
        F.when(F.col("reason") == "trial", days).cast("int").alias("trial_days_remaining"),
        F.when(paid, F.col("sub.plan_id")).alias("plan_id"),
        F.when(paid, F.col("sub.subscription_id")).alias("subscription_id"),
    )


def trial_activation(attempts: DataFrame, issues: DataFrame, users: DataFrame) -> DataFrame:
    """Outcome of every verification attempt.

    ``issues``: user_id, at, event_id, code; ``attempts``: the same with the
    code typed in; ``users``: user_id, is_verified at the start. A code holds
    from its issue until the next one and expires after 15 minutes. The code in
    force is found by one ordered pass over issues and attempts together, in
    day segments, not by joining all pairs of a user.
    """
    tagged = issues.select(
        "user_id", "at", "event_id", F.lit(0).alias("is_attempt"), F.lit(None).cast("string").alias("typed"),
        F.struct("code", "at").alias("issue"),
    ).unionByName(attempts.select(
        "user_id", "at", "event_id", F.lit(1).alias("is_attempt"), F.trim("code").alias("typed"),
        F.lit(None).cast("struct<code:string,at:timestamp_ntz>").alias("issue"),
    ))
    order = ["at", "is_attempt", "event_id"]
    placed = segmented_last(tagged, ["user_id"], order, F.to_date("at"), F.col("issue"), "in_force").where("is_attempt = 1")
    code = F.trim(F.col("in_force.code"))
    verdict = (
        F.when(F.coalesce(code, F.lit("")) == "", "invalid_code")
        .when(code != F.col("typed"), "invalid_code")
        .when(F.col("at") > F.col("in_force.at") + F.expr(f"INTERVAL {CODE_MINUTES} MINUTES"), "code_expired")
        .otherwise("verified")
    )
    judged = placed.withColumn("_verdict", verdict)
    firsts = judged.where("_verdict = 'verified'").groupBy("user_id").agg(
        F.min(F.struct("at", "event_id")).alias("_first")
    )
    state = users.select("user_id", "is_verified").join(firsts, "user_id", "left")
    df = judged.join(state, "user_id", "left")
    here = F.struct("at", "event_id")
    outcome = (
        F.when(F.col("is_verified").isNull(), "user_not_found")
        .when(F.col("is_verified") | (F.col("_first") < here), "already_verified")
        .otherwise(F.col("_verdict"))
    )
    df = df.withColumn("outcome", outcome)
    verified = F.col("outcome") == "verified"
    return df.select(
        "event_id", "user_id", F.col("at").alias("tried_at"), "outcome",
        F.when(verified, F.col("at")).alias("trial_started_at"),
        F.when(verified, F.col("at") + F.expr(f"INTERVAL {TRIAL_DAYS} DAYS")).alias("trial_ends_at"),
    )


def event_log(events: DataFrame, limit: int | None = 50) -> DataFrame:
    """The newest deliveries with a display name; all of them without a limit."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be 1 or more, or None for all")
    newest = events.orderBy(F.desc("received_at"), F.desc("delivery_id"))
    return (newest if limit is None else newest.limit(limit)).select(
        "delivery_id", "event_id", "event_type",
        F.coalesce(non_blank(F.col("subscriber_name")), non_blank(F.col("subscription_id")), F.lit("Unknown")).alias("display_name"),
        "amount", "currency", "result", "error_detail", "received_at",
    )


def event_log_totals(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("count"), F.count_if(F.col("result") != "processed").alias("failed"))
