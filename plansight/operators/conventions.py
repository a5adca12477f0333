"""Naming conventions and PII guard.

Event names follow ``object_action[_lifecycle]`` in snake_case; property
values must not carry personal data. Both are narrow column expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from ..functions.util import at as _at

# The six lifecycle suffixes of the naming convention.
LIFECYCLES = ["attempt", "success", "fail", "start", "complete", "skip"]

SNAKE = r"^[a-z][a-z0-9]*(_[a-z0-9]+)+$"
# PII detectors applied to free text (own patterns; the contract only says
# "no PII values").
PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}",
    "card": r"\b\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}\b",
}


def name_lint(names: DataFrame, col: str = "name") -> DataFrame:
    n = F.col(col)
    last = _at(F.split(n, "_"), -1)
    return names.select(
        n.alias("name"),
        n.rlike(SNAKE).alias("is_snake_case"),
        F.when(last.isin(*LIFECYCLES), last).alias("lifecycle"),
        (n.rlike(SNAKE) & (F.size(F.split(n, "_")) >= (F.when(last.isin(*LIFECYCLES), 3).otherwise(2))))
        .alias("follows_convention"))


def pii_counts(df: DataFrame, text_col: str, key: str) -> DataFrame:
    """Number of matches of each PII pattern per row of free text."""
    return df.select(key, *[F.size(F.regexp_extract_all(F.col(text_col), F.lit(p), 0)).alias(f"n_{k}")
                            for k, p in PII_PATTERNS.items()])


# ---------------------------------------------------------------------------
# Domain activation signals (path substrings, component names,
# code patterns), in the reference's order.
# ---------------------------------------------------------------------------
SIGNALS = {
    "onboarding": {
        "paths": ["signup", "register", "registration", "onboarding", "welcome", "getting-started", "verify",
                  "verification", "confirm-email", "auth/signup"],
        "components": ["SignupForm", "SignupPage", "RegistrationPage", "RegistrationForm", "OnboardingWizard",
                       "OnboardingStep", "OnboardingFlow", "WelcomePage", "VerifyEmail", "ConfirmEmail"],
        "patterns": [r"signUp|sign_up|createUser|create_user", r"verifyEmail|verify_email|confirmEmail|confirm_email",
                     r"verification[-_]?token|emailVerification", r"supabase\.auth\.signUp|firebase\.auth\(\)\.createUser",
                     r"Auth0|Clerk|getAuth|useAuth", r"currentStep|nextStep|stepIndex|step_index|onboardingStep",
                     r"stepper|wizard|multiStep|multi_step"],
    },
    "billing": {
        "paths": ["billing", "subscription", "checkout", "payment", "pricing", "plan", "upgrade", "invoice", "stripe"],
        "components": ["BillingPage", "SubscriptionCard", "PricingTable", "CheckoutForm", "UpgradeModal",
                       "PlanSelector", "PaymentForm", "BillingSettings", "SubscriptionPage"],
        "patterns": [r"stripe|paddle|lemon.?squeezy|braintree|recurly|chargebee",
                     r"createCheckoutSession|createSubscription|billing.?portal|customer\.portal",
                     r"trial.*start|trial.*end|subscription.*created|plan.*upgrade",
                     r"payment_intent|paymentIntent|invoice\.paid|subscription\.updated",
                     r"dunning|mrr|arr|churn|ltv|lifetime.?value"],
    },
    "search": {
        "paths": ["search", "results", "query", "filter", "find", "discover"],
        "components": ["SearchBar", "SearchResults", "SearchInput", "SearchPage", "FilterPanel", "ResultsList",
                       "SearchModal", "CommandPalette", "SearchDropdown"],
        "patterns": [r"useSearch|searchQuery|searchResults|searchTerm|search_term",
                     r"algolia|elasticsearch|elastic_search|typesense|meilisearch|solr|opensearch",
                     r"onSearch|handleSearch|performSearch|search\.perform",
                     r"\bq=|\bquery=|search_query|filter.*apply|facet",
                     r"zero.*result|no.*result|empty.*result|result_count\s*===?\s*0"],
    },
    "collaboration": {
        "paths": ["team", "members", "invite", "workspace", "organization", "org", "permission", "role", "access"],
        "components": ["TeamSettings", "InviteModal", "MemberList", "RoleSelector", "WorkspaceSettings",
                       "OrgSettings", "InviteForm", "MemberCard", "PermissionGate"],
        "patterns": [r"inviteUser|sendInvite|invite.*email|invitation|inviteTeamMember",
                     r"workspace|team.*member|organization.*member|org.*member",
                     r"role.*change|permission.*update|access.*level|changeRole|updateRole",
                     r"addMember|removeMember|kick.*member|transfer.*ownership",
                     r"seat.*limit|seat.*count|members\.create|members\.delete"],
    },
}

# Reasons shown for convention events missing from the code; the first test that holds wins.
MISSING_REASONS = [
    ("name contains", "signup", "No signup flow handler found"),
    ("name contains", "email_verification", "No verification email trigger found"),
    ("name contains", "onboarding_step", "Onboarding flow detected but steps not instrumented"),
    ("name is", "onboarding_complete", "Onboarding complete handler not instrumented"),
    ("name is", "subscription_trial_start", "Trial start not instrumented — required for conversion funnel"),
    ("name is", "subscription_trial_convert", "Trial conversion not instrumented — key revenue event"),
    ("name is", "subscription_trial_expire", "Trial expiry not instrumented — required for churn analysis"),
    ("name is", "subscription_cancelled", "Cancellation flow not instrumented — required for churn analysis"),
    ("name is", "subscription_upgraded", "Upgrade path not instrumented"),
    ("name is", "subscription_downgraded", "Downgrade path not instrumented"),
    ("name is", "payment_fail", "Payment failure handler not instrumented — required for revenue recovery"),
    ("domain is", "billing", "Billing event not instrumented"),
    ("name is", "search_performed", "Search handler not instrumented"),
    ("name is", "search_no_results", "Zero-results state not instrumented — key quality signal"),
    ("name is", "search_result_clicked", "Result click not instrumented — needed for relevance analysis"),
    ("domain is", "search", "Search event not instrumented"),
    ("name is", "member_invited", "Invitation flow not instrumented — required for PLG seat expansion"),
    ("name is", "member_invite_accepted", "Invite acceptance not instrumented"),
    ("name is", "workspace_created", "Workspace creation not instrumented"),
    ("domain is", "collaboration", "Collaboration event not instrumented"),
]
NO_REASON = "Not found in codebase"


def domain_activation(files: DataFrame) -> DataFrame:
    """Domains with at least two distinct signal types (path, component,
    pattern) anywhere in the repo. Every signal is a literal expression."""
    p = F.lower(F.regexp_replace("path", r"\\", "/"))
    c = F.col("content")
    aggs = []
    for dom, sig in SIGNALS.items():
        path_hit = reduce(lambda a, b: a | b, [p.contains(s) for s in sig["paths"]])
        comp_hit = reduce(lambda a, b: a | b, [c.contains(s) for s in sig["components"]])
        pat_hit = reduce(lambda a, b: a | b, [c.rlike("(?i)" + s) for s in sig["patterns"]])
        aggs += [F.bool_or(path_hit).alias(f"{dom}__path"), F.bool_or(comp_hit).alias(f"{dom}__component"),
                 F.bool_or(pat_hit).alias(f"{dom}__pattern")]
    flags = files.groupBy("repo").agg(*aggs)
    rows = F.array(*[F.struct(F.lit(dom).alias("domain"),
                              (F.col(f"{dom}__path").cast("int") + F.col(f"{dom}__component").cast("int")
                               + F.col(f"{dom}__pattern").cast("int")).alias("n_signal_types"),
                              F.col(f"{dom}__path").alias("path_signal"),
                              F.col(f"{dom}__component").alias("component_signal"),
                              F.col(f"{dom}__pattern").alias("pattern_signal")) for dom in SIGNALS])
    return flags.select("repo", F.explode(rows).alias("d")).select("repo", "d.*") \
        .withColumn("active", F.col("n_signal_types") >= 2)


def missing_reason(domain: Column, name: Column) -> Column:
    tests = {"name contains": name.contains, "name is": lambda v: name == v, "domain is": lambda v: domain == v}
    return F.coalesce(*[F.when(tests[test](value), text) for test, value, text in MISSING_REASONS], F.lit(NO_REASON))


def convention_coverage(conv_events: DataFrame, conv_attrs: DataFrame, detected: DataFrame,
                        lines: DataFrame, domains: DataFrame) -> DataFrame:
    """J11 (+ F20 ``required_hint``): per repo, each event of its domains matched to the first location of the
    detected event of the same (lower-cased) name, with the required
    attributes missing from that line and the five after it; or missing,
    with a reason and the required attribute list.

    ``detected(repo, key, path, line_no)`` is the first location per name in
    the repo; ``domains(repo, domain)`` the domains that apply to it.
    """
    ce = conv_events.withColumn("_k", F.lower("name")).join(domains, "domain")
    d = detected.select("repo", F.col("key").alias("_k"), "path", "line_no")
    m = ce.join(d, ["repo", "_k"], "left")
    req = conv_attrs.where("required")
    # attribute test on lines line_no .. line_no+5
    probe = m.where(F.col("path").isNotNull()).select("repo", "domain", "name", "path", "line_no")
    win = probe.withColumn("_l", F.explode(F.sequence(F.col("line_no"), F.col("line_no") + 5)))
    ctx = (win.join(lines.select("repo", "path", F.col("line_no").alias("_l"), "text"), ["repo", "path", "_l"])
           .groupBy("repo", "domain", "name", "path", "line_no")
           .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_l", "text"))), lambda s: s["text"]), "\n")
                .alias("_ctx")))
    ra = ctx.join(req.select(F.col("event_name").alias("name"), "attr", "ord"), "name")
    key_rx = F.concat(F.lit("[\"']?"), F.regexp_replace(F.col("attr"), "_", "[_s]?"), F.lit("[\"']?\\s*:"))
    word_rx = F.concat(F.lit("\\b"), F.col("attr"), F.lit("\\b"))
    present = F.regexp_like(F.col("_ctx"), key_rx) | F.regexp_like(F.col("_ctx"), word_rx)
    miss = (ra.where(~present).groupBy("repo", "domain", "name")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "attr"))), lambda s: s["attr"]), ",")
                 .alias("missing_required")))
    hint = F.when((F.col("type") == "enum") & F.col("values").isNotNull(),
                  F.concat("attr", F.lit(" (enum: "), F.array_join("values", ", "), F.lit(")"))).otherwise(F.col("attr"))
    hints = (req.groupBy(F.col("event_name").alias("name")).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", hint.alias("h")))), lambda s: s["h"]), ", ").alias("required_hint")))
    matched = (m.where(F.col("path").isNotNull()).join(miss, ["repo", "domain", "name"], "left")
               .join(hints, "name", "left")
               .select("repo", "domain", "name", F.lit("matched").alias("state"),
                       F.concat("path", F.lit(":"), F.col("line_no").cast("string")).alias("location"),
                       F.coalesce("missing_required", F.lit("")).alias("missing_required"),
                       F.lit(None).cast("string").alias("reason"), "required_hint"))
    req_list = (req.groupBy(F.col("event_name").alias("name")).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", F.when((F.col("type") == "enum") & F.col("values").isNotNull(),
                                                           F.concat("attr", F.lit(" (enum)"))).otherwise(F.col("attr")).alias("a")))),
        lambda s: s["a"]), ",").alias("_req")))
    missing = (m.where(F.col("path").isNull()).join(req_list, "name", "left")
               .select("repo", "domain", "name", F.lit("missing").alias("state"), F.lit(None).cast("string").alias("location"),
                       F.coalesce("_req", F.lit("")).alias("missing_required"),
                       missing_reason(F.col("domain"), F.col("name")).alias("reason"),
                       F.lit(None).cast("string").alias("required_hint")))
    return matched.unionByName(missing)


def payload_check(events: DataFrame, conv_attrs: DataFrame) -> DataFrame:
    """Events named like a convention event, checked for required
    attributes, enum membership and JSON type of present attributes."""
    from .contracts import json_type_of
    names = sorted({r.attr for r in conv_attrs.select("attr").distinct().collect()})
    v = F.try_parse_json("properties")
    types = F.create_map(*[x for n in names for x in (
        F.lit(n), F.schema_of_variant(F.try_variant_get(v, "$['" + n + "']", "variant")))])
    vals = F.create_map(*[x for n in names for x in (F.lit(n), F.get_json_object("properties", "$." + n))])
    ev = events.select("event_id", "event_name", F.json_object_keys("properties").alias("_keys"),
                       types.alias("_t"), vals.alias("_v"))
    ca = F.broadcast(conv_attrs.select(F.col("event_name").alias("_n"), "attr", "type", "required", "values"))
    j = ev.join(ca, F.lower(ev["event_name"]) == F.lower(ca["_n"]))
    present = F.coalesce(F.array_contains("_keys", F.col("attr")), F.lit(False))
    actual = json_type_of(_at("_t", F.col("attr")))
    val = _at("_v", F.col("attr"))
    expected = F.when(F.col("type").isin("enum", "string"), "string").otherwise(F.col("type"))
    viol = (F.when(F.col("required") & ~present, "missing")
            .when(present & (F.col("type") == "enum") & (actual == "string") & ~F.array_contains("values", val), "not_in_enum")
            .when(present & (actual != expected), "type_mismatch"))
    return (j.withColumn("violation", viol).where(F.col("violation").isNotNull())
            .select("event_id", "event_name", "attr", "violation"))
