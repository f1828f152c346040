"""Views of the given tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatweave.functions.columns import HASH_SPACE, stable_hash
from threatweave.functions.fixed import CANONICAL_CLASSES, ENTITY_FIELDS
from threatweave.operators.gates import alert_level
from threatweave.session import use_utc

EVENT_RULES = {
    "rules": [
        {
            "id": "W001", "name": "error_then_purchase",
            "description": "Error followed by a purchase of the same user within an hour.",
            "severity": "high", "confidence": 0.85, "max_span": "2h",
            "sequence": [
                {"event_type": "error"},
                {"event_type": "purchase", "within": "1h", "same": ["entities.user"]},
            ],
        },
        {
            "id": "W002", "name": "view_click_purchase", "severity": "medium", "confidence": 0.60,
            "max_span": "12h",
            "sequence": [
                {"event_type": "view"},
                {"event_type": "click", "within": "4h", "same": ["entities.user"]},
                {"event_type": "purchase", "within": "4h", "same": ["entities.user", "entities.dst_ip"]},
            ],
        },
        {
            "id": "W003", "name": "repeated_error", "severity": "critical", "confidence": 0.90,
            "sequence": [
                {"event_type": "error", "where": {"min_severity": 3}},
                {"event_type": "error", "within": "30m", "same": ["entities.user", "entities.dst_ip"],
                 "where": {"min_confidence": 0.01}},
            ],
        },
        {
            "id": "W004", "name": "signup_then_view", "severity": "low", "confidence": 0.40,
            "max_span": "5m",
            "sequence": [
                {"event_type": "signup", "within": "1m"},
                {"event_type": "view", "within": "10m", "where": {"tag_any": ["high", "mid"]}},
            ],
        },
        {
            "id": "W005", "name": "switched_off", "enabled": False, "severity": "low", "confidence": 0.70,
            "sequence": [{"event_type": "click"}, {"event_type": "no_such_type", "within": "1h"}],
        },
    ]
}

# The same set with rules that repeat an id: one as it is, one with other steps, one of a single step.
REPEATED_RULES = {
    "rules": EVENT_RULES["rules"] + [
        EVENT_RULES["rules"][0],
        {**EVENT_RULES["rules"][0], "confidence": 0.3, "max_span": "10m", "sequence": [
            {"event_type": "click", "within": "1m"}, {"event_type": "nowhere", "within": "20m"}]},
        {**EVENT_RULES["rules"][3], "sequence": [{"event_type": "signup", "within": "1m"}]},
    ],
}

TWO_STEP = {"rules": EVENT_RULES["rules"][:1]}
THREE_STEP = {"rules": EVENT_RULES["rules"][1:2]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def events_in(df: DataFrame) -> DataFrame:
    """``events`` rows as normalised security events."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 500))
    severity = F.least(F.lit(10), F.greatest(F.lit(1), (1 + F.floor(F.col("value") / 50)).cast("int")))
    port = F.get_json_object("props", "$.k")
    known = {"dst_ip": F.concat(F.lit("10.0.0."), port), "user": F.col("user_id").cast("string")}
    return df.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("event_id").alias("ord"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_type",
        F.lit("events").alias("source"),
        severity.alias("severity"),
        share.alias("confidence"),
        F.array(F.when(F.col("value") >= 100, "high").when(F.col("value") >= 20, "mid").otherwise("low")).alias("tags"),
        F.struct(*[known.get(f, F.lit(None).cast("string")).alias(f) for f in ENTITY_FIELDS]).alias("entities"),
    )


def security_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_in(table(spark, sf_dir, "events"))


def trap_events_in(df: DataFrame) -> DataFrame:
    """``events`` rows as trap events: mostly by address, some by path, some local."""
    k = F.get_json_object("props", "$.k").cast("int")
    local = F.col("event_type") == "purchase"
    by_path = F.col("event_type") == "view"
    action = (
        F.when(F.col("event_type") == "signup", "service_connect").when(F.col("event_type") == "error", "canary_triggered")
        .when(F.col("event_type") == "click", "file_read").when(F.col("event_type") == "view", "file_copy")
        .otherwise("file_delete")
    )
    return df.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("event_id").alias("ord"),
        F.concat(F.lit("trap-"), k.cast("string")).alias("trap_id"),
        F.lit("file_share").alias("trap_type"),
        action.alias("action"),
        F.struct(
            F.when(local, F.lit(None)).when(by_path, F.lit("")).otherwise(F.concat(F.lit("10.1.0."), F.col("user_id").cast("string"))).alias("remote_ip"),
            F.when(local & (k >= 50), F.lit(None)).otherwise(F.concat(F.lit("/srv/share/"), k.cast("string"))).alias("file_path"),
        ).alias("source"),
        F.lit("HIGH").alias("severity"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def trap_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trap_events_in(table(spark, sf_dir, "events"))


FLOW_LABELS = {"signup": "BENIGN", "error": "PortScan", "click": "DoS", "view": "WebAttack", "purchase": "BruteForce"}


def flow_alerts_in(df: DataFrame) -> DataFrame:
    """``events`` rows as scored flows, ten sources towards one destination."""
    label = F.lit(None).cast("string")
    for kind, name in FLOW_LABELS.items():
        label = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(label)
    p = F.least(F.lit(1.0), F.col("value") / 100)
    flows = df.select(
        "event_id",
        F.col("event_id").alias("ord"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("ts"),
        F.concat(F.lit("10.1.0."), F.pmod("user_id", F.lit(10)).cast("string")).alias("src_ip"),
        F.lit("10.0.0.1").alias("dst_ip"),
        F.get_json_object("props", "$.k").cast("int").alias("dst_port"),
        label.alias("label"),
        p.alias("p_attack"),
        (F.col("value") / 50).alias("margin"),
    )
    return flows.withColumn("alert_level", alert_level(F.col("label"), F.col("p_attack")))


def flow_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_alerts_in(table(spark, sf_dir, "events"))


def _json(**parts: Column) -> Column:
    """JSON object text of ready-made JSON values; NULL ones are left out."""
    pairs = [F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in parts.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c.cast("string"), F.lit('"'))


def raw_events_in(df: DataFrame) -> DataFrame:
    """``events`` rows as payloads of five producers, good and bad ones alike."""
    df = df.withColumns(
        {
            "k": F.get_json_object("props", "$.k").cast("int"),
            "sev": F.least(F.lit(10), (1 + F.floor(F.col("value") / 50)).cast("int")),
            "at": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
        }
    )
    k, sev, at = F.col("k"), F.col("sev"), F.col("at")
    kt = k.cast("string")
    plain = _json(
        event_type=F.lit('" signup "'), timestamp=_quoted(F.col("ts")), user=_quoted(F.col("user_id")),
        url=_quoted(F.concat(F.lit("HTTPS://Host"), kt, F.lit(".Example.com:8080/p"))),
        severity=_quoted(sev), confidence=(F.col("value") / 500).cast("string"), tags=F.lit('"a, b,,c"'),
    )
    network = _json(
        alert_type=F.lit('"port_scan"'), time=(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("string"),
        source_ip=_quoted(F.concat(F.lit(" 10.0.0."), kt)), dest_ip=_quoted(F.concat(F.lit("10.0."), (k * 3).cast("string"), F.lit(".1"))),
        score=(F.col("value") / 200).cast("string"), sev=(sev + F.lit(0.7)).cast("string"),
    )
    phishing = _json(
        is_phishing=F.lit("true"), ts=_quoted(F.concat(at, F.lit("+05:30"))), sender=_quoted(F.concat(F.lit(" a"), F.col("user_id").cast("string"), F.lit("@x.org "))),
        recipient=F.lit('"b@y.org"'), link=_quoted(F.concat(F.lit("http://evil"), kt, F.lit(".example.net/login"))),
        risk_score=_quoted(F.concat(F.lit("0."), kt)), tags=F.lit('["x"," ","y"]'), stage=F.lit('"delivery"'),
    )
    intel = _json(
        indicator=_quoted(
            F.when(k < 30, F.concat(F.lit("10.9.8."), kt)).when(k < 60, F.concat(F.lit("bad"), kt, F.lit(".example.org")))
            .otherwise(F.concat(F.lit("https://bad.example.org/"), kt))
        ),
        type=F.lit('"domain_flagged"'), event_time=F.when(k % 10 != 0, _quoted(F.concat(at, F.lit("Z")))), risk_score=F.lit("0.7"),
    )
    other = _json(
        name=F.lit('"purchase"'), datetime=F.when(k < 10, F.lit('"not a time"')).otherwise(_quoted(at)), level=kt,
        probability=(k / 50).cast("string"), host=_quoted(F.concat(F.lit("web"), kt, F.lit(".corp.example"))), account=F.col("user_id").cast("string"),
    )
    e = F.col("event_type")
    return df.select(
        F.col("event_id").alias("ord"),
        F.when(e == "signup", "raw").when(e == "error", "network").when(e == "click", "phishing").when(e == "view", "url_intel")
        .when(k >= 90, "mystery").otherwise("raw").alias("kind"),
        F.when(e == "signup", plain).when(e == "error", network).when(e == "click", phishing).when(e == "view", intel).otherwise(other).alias("raw"),
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_events_in(table(spark, sf_dir, "events"))


def flow_dataset_in(df: DataFrame) -> DataFrame:
    """``lineitem`` rows as labelled flows with the usual dirt in labels and numbers."""
    no, flag = F.col("l_linenumber"), F.col("l_returnflag")
    label = (
        F.when((no == 1), "  Benign ").when((no == 2) & (flag == "A"), F.lit(None)).when(no == 2, "BENIGN")
        .when((no == 3) & (flag == "R"), "DoS other").when(no == 3, "DoS Hulk").when(no == 4, "FTP-Patator")
        .when((no == 5) & (flag == "N"), "Web Attack � Sql Injection").when(no == 5, "Web  Attack – XSS")
        .when((no == 6) & (flag == "R"), "Botnet").when(no == 6, "Bot")
        .when(flag == "A", "Unknown thing").otherwise("WebAttack- Brute Force")
    )
    return df.select(
        F.concat(F.lit("part-"), "l_linestatus", F.lit(".parquet")).alias("file"),
        label.alias("Label"),
        F.col("l_quantity").alias("quantity"),
        F.when(F.col("l_tax") == 0.08, F.lit(float("nan"))).when(F.col("l_tax") > 0, F.col("l_tax")).alias("tax"),
        F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_quantity") / F.col("l_discount")).alias("rate"),
        F.col("l_extendedprice").alias("price"),
        F.lit(7).alias("protocol"),
        F.col("l_partkey").alias("attack port"),
        flag.alias("class name"),
    )


def flow_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_dataset_in(table(spark, sf_dir, "lineitem"))


def labelled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` rows with a class by priority and status."""
    p, st = F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus")
    label = (
        F.when(p == "1", "DDoS").when(p == "2", "DoS").when((p == "3") & (st == "P"), "Odd")
        .when(p == "4", "PortScan").otherwise("BENIGN")
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", "o_totalprice", label.alias("label"),
        F.when(p == "1", "Friday-flows").otherwise("Monday-flows").alias("file"),
    )


def scored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled orders with a made prediction and score that depend on the price alone."""
    price = F.col("o_totalprice")
    guess = F.when(price < 100_000, "BENIGN").when(price < 200_000, "DDoS").when(price < 300_000, "DoS").when(price < 350_000, "PortScan").otherwise(F.col("label"))
    return labelled_orders(spark, sf_dir).withColumns({"prediction": guess, "score": F.pmod(F.col("o_orderkey") * 37, F.lit(101)) / 100})


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as numeric columns e0, e1, … with a class label."""
    df = table(spark, sf_dir, "embeddings")
    dims = [F.get("embedding", F.lit(i)).alias(f"e{i}") for i in range(64)]
    return df.select("vec_id", F.col("label").cast("string").alias("label"), *dims)


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages.url`` as they are and with the traits that matter, with a made probability."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    kinds = F.array(
        F.col("url"),
        F.replace("url", F.lit(".example."), F.lit(".secure-login.")),
        F.concat(F.lit("http://10.1.2."), F.pmod("page_id", F.lit(256)).cast("string"), F.lit(":8080//verify?account=1&b=&c=2&c=3")),
        F.concat(host, F.lit("/free-gift/paypal;p=1?x=%41@y")),
        F.concat(F.lit("https://bit.ly.shop.co.uk/a/b/c/"), host, F.lit("#confirm")),
        F.concat(F.lit("https://user:pw@a.b.c.d.update-bank.xyz/"), F.repeat("url", 4)),
    )
    return pages.select("page_id", F.posexplode(kinds).alias("kind", "url")).withColumn("p", F.pmod(F.length("url") * 13, F.lit(101)) / 100)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns, each followed by what mail is full of."""
    t = table(spark, sf_dir, "conversations")
    tail = F.concat(
        F.lit(" Dear Customer, click here within 24 hours: HTTPS://evil-"), F.col("turn").cast("string"),
        F.lit(".example/x?y=1 or mail a.b@c.example, call +1 (555) 010-"), (F.col("conv_id") % 9000 + 1000).cast("string"),
        F.lit(". Verify your account_id 42 now, I am not joking!"),
    )
    return t.select("conv_id", "turn", "role", F.when(F.col("turn") % 2 == 0, F.concat("text", tail)).otherwise(F.col("text")).alias("text"))


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` with class names for labels, split by hash."""
    df = table(spark, sf_dir, "embeddings")
    names = F.array(*map(F.lit, CANONICAL_CLASSES))
    label = F.get(names, F.least(F.col("label"), F.lit(len(CANONICAL_CLASSES) - 1)))
    share = stable_hash(42, "vec_id") / HASH_SPACE
    split = F.when(share < 0.2, "test").when(share < 0.35, "val").otherwise("train")
    return df.select("vec_id", label.alias("label"), F.col("embedding").alias("features"), split.alias("split"))
