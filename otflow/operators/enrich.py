"""Enrichment, compliance, threat-intelligence and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.knowledge import CVE_KEYWORDS, DEFAULT_MITIGATION, FLOW_PORTS, ICS_PORTS, IEC_VIOLATIONS, MITIGATIONS, RULES, SEVERITIES, VENDORS, ZONES, mitre, patterns, rows
from ..functions.scalar import cut, cvss_severity, cvss_to_sl, percent_text, title, zone_of_port, zone_severity
from .ordered import spread

RANK = {s: n for s, n in SEVERITIES}


def severity_rank(c: Column) -> Column:
    c = F.upper(c)
    return F.when(c == "CRITICAL", 4).when(c == "HIGH", 3).when(c == "MEDIUM", 2).when(c == "LOW", 1).otherwise(0)


def pattern_info(detections: DataFrame) -> DataFrame:
    dim = patterns(detections.sparkSession).select("pattern", "name", "technique")
    return detections.join(F.broadcast(dim), "pattern", "left")


def pattern_summary(detections: DataFrame) -> DataFrame:
    """Per pattern: flows, worst severity, mean confidence."""
    worst = F.max_by("severity", severity_rank(F.col("severity")))
    return detections.groupBy("pattern").agg(F.count(F.lit(1)).alias("n_flows"), worst.alias("severity"), F.avg("confidence").alias("confidence")).withColumn("detected", F.lit(True))


def techniques(summary: DataFrame) -> DataFrame:
    """One row a technique: the first of its patterns in detection order."""
    dim = mitre(summary.sparkSession)
    held = summary.select("pattern").join(F.broadcast(dim), "pattern")
    first = F.row_number().over(Window.partitionBy("technique_id").orderBy("ord"))
    return held.withColumn("turn", first).where("turn = 1").select("pattern", "technique_id", "technique_name", "tactic", F.concat(F.lit("https://attack.mitre.org/techniques/"), "technique_id", F.lit("/")).alias("url"))


def iec_violations(summary: DataFrame) -> DataFrame:
    dim = rows(summary.sparkSession, IEC_VIOLATIONS, "pattern string, requirement string, description string, required_sl string")
    return summary.select("pattern").join(F.broadcast(dim), "pattern")


def mitigations(summary: DataFrame) -> DataFrame:
    dim = rows(summary.sparkSession, [(p, list(s)) for p, s in MITIGATIONS.items()], "pattern string, steps array<string>")
    held = summary.select("pattern").join(F.broadcast(dim), "pattern", "left")
    return held.select("pattern", F.posexplode(F.coalesce("steps", F.array(F.lit(DEFAULT_MITIGATION)))).alias("step", "text"))


def timeline(summary: DataFrame) -> DataFrame:
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("rank"), "pattern")  # one row a pattern
    return summary.select("pattern", "severity", severity_rank(F.col("severity")).alias("rank"), title(F.col("pattern")).alias("title")).withColumn("place", F.row_number().over(w))


def report_summary(summary: DataFrame) -> DataFrame:
    return summary.agg(F.count(F.lit(1)).alias("n_patterns"), F.max_by("severity", severity_rank(F.col("severity"))).alias("max_severity"), F.sum("n_flows").alias("total_flows"))


def top_examples(detections: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` detections of a pattern, kept by map-side combination, and how many more there are."""
    each = detections.select("pattern", F.struct("row_id", "confidence").alias("x"))
    part = F.pmod(F.xxhash64("x"), F.lit(256))
    first = F.row_number().over(Window.partitionBy("pattern", "part").orderBy("x"))
    few = each.withColumn("part", part).withColumn("turn", first).where(F.col("turn") <= n)  # n rows of each part
    place = F.row_number().over(Window.partitionBy("pattern").orderBy("x"))
    held = few.select("pattern", "x", place.alias("place")).where(F.col("place") <= n)
    totals = detections.groupBy("pattern").agg(F.count(F.lit(1)).alias("total"))  # one row a pattern
    return held.join(F.broadcast(totals), "pattern").select("pattern", "place", "x.row_id", F.greatest(F.col("total") - n, F.lit(0)).alias("more"))


def affected_ips(marked: DataFrame, names: list[str], n: int = 5) -> DataFrame:
    """Per pattern: how many addresses, and the first ``n``. No row holds more than ``n`` of them.

    ``marked`` has row_id, sIPs, rIPs and ``marks``, whose bit k tells that ``names[k]`` was found in the row. As in a join
    by id, rows that share an id share their marks, and a row without an id has none. Each row is exchanged once, an address
    once a task."""
    same = Window.partitionBy("row_id")
    held = spread(marked.where("row_id is not null"), "row_id").withColumn("marks", F.bit_or("marks").over(same)).where("marks <> 0")
    ips = held.select("marks", F.explode(F.array("sIPs", "rIPs")).alias("ip")).groupBy("ip").agg(F.bit_or("marks").alias("marks"))
    found = F.array_compact(F.array(*[F.when(F.getbit("marks", F.lit(k)) == 1, name) for k, name in enumerate(names)]))
    part = F.pmod(F.xxhash64("ip"), F.lit(256))
    turn = F.row_number().over(Window.partitionBy("pattern", "part").orderBy(F.asc_nulls_last("ip")))
    each = ips.select(F.explode(found).alias("pattern"), "ip").withColumn("part", part).withColumn("turn", turn)
    first = F.collect_list(F.when(F.col("turn") <= n, F.col("ip")))  # n rows of 256 parts
    return each.groupBy("pattern").agg(F.count("ip").alias("n_ips"), F.array_join(F.slice(F.array_sort(first), 1, n), ",").alias("first_ips"))


def port_protocol(flows: DataFrame) -> DataFrame:
    return flows.join(F.broadcast(rows(flows.sparkSession, FLOW_PORTS, "dst_port int, protocol_name string")), "dst_port", "left")


def protocol_counts(flows: DataFrame) -> DataFrame:
    dim = rows(flows.sparkSession, FLOW_PORTS, "dst_port int, protocol_name string")
    counts = flows.groupBy("dst_port").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(dim).join(counts, "dst_port", "left").select("protocol_name", F.coalesce("n", F.lit(0)).alias("n"))


def port_zone(flows: DataFrame, score: Column) -> DataFrame:
    port = F.col("dst_port")
    return flows.withColumns({"zone": zone_of_port(port), "zone_severity": zone_severity(port, score)})


# --- vulnerabilities -----------------------------------------------------------------


def cves_of(response: DataFrame) -> DataFrame:
    """CVE rows of NVD v2 responses (a ``vulnerabilities`` array)."""
    each = response.select(F.explode("vulnerabilities.cve").alias("c"))
    kinds = each.schema["c"].dataType["metrics"].dataType.names
    score = F.coalesce(*[F.get(F.col(f"c.metrics.{k}"), 0)["cvssData"]["baseScore"].cast("double") for k in ("cvssMetricV31", "cvssMetricV30", "cvssMetricV2") if k in kinds], F.lit(None).cast("double"))
    english = F.get(F.filter("c.descriptions", lambda d: d["lang"] == "en"), 0)["value"]
    return each.select(F.col("c.id").alias("cve_id"), cut(F.coalesce(english, F.lit("")), 300).alias("description"), score.alias("cvss_score"), cvss_severity(score).alias("severity"), cvss_to_sl(score).alias("iec_sl"), F.col("c.published").alias("published"))


def pattern_cves(summary: DataFrame, cves: DataFrame, limit: int = 5) -> DataFrame:
    """Per pattern: CVEs whose description has all words of its search, the first, and the level it asks for."""
    dim = rows(summary.sparkSession, CVE_KEYWORDS, "pattern string, keyword string")
    words = F.split(F.lower("keyword"), " ")
    hits = F.broadcast(dim).join(cves, F.forall(words, lambda w: F.contains(F.lower("description"), w)))
    ranked = hits.withColumn("turn", F.row_number().over(Window.partitionBy("pattern").orderBy("cve_id"))).where(F.col("turn") <= limit)
    found = ranked.groupBy("pattern").agg(F.count(F.lit(1)).alias("cves_found"), F.min_by("cve_id", "turn").alias("top_cve"), F.min_by("iec_sl", "turn").alias("required_iec_sl"))
    return summary.select("pattern").join(found, "pattern", "left").select("pattern", F.coalesce("cves_found", F.lit(0)).alias("cves_found"), "top_cve", F.coalesce("required_iec_sl", F.lit("SL-2")).alias("required_iec_sl"))


def vendor_cves(cves: DataFrame) -> DataFrame:
    dim = rows(cves.sparkSession, VENDORS, "vendor string, product string")
    hits = F.broadcast(dim).join(cves, F.contains(F.lower("description"), F.col("product"))).dropDuplicates(["vendor", "cve_id"])
    count = lambda s: F.sum(F.when(F.col("severity") == s, 1).otherwise(0))
    return hits.groupBy("vendor").agg(F.count(F.lit(1)).alias("total"), count("CRITICAL").alias("critical"), count("HIGH").alias("high"), F.max("iec_sl").alias("max_sl"))


# --- compliance ------------------------------------------------------------------------


def segmentation(flows: DataFrame) -> DataFrame:
    ratio = F.avg(F.when(F.col("dst_port").isin(ICS_PORTS), 1.0).otherwise(0.0)) if "dst_port" in flows.columns else F.lit(0.0)
    one = flows.agg(F.coalesce(ratio, F.lit(0.0)).alias("ratio")).withColumn("score", F.greatest(1 - 2 * F.col("ratio"), F.lit(0.0)))
    return one.select("ratio", "score", F.when(F.col("score") >= 0.8, "COMPLIANT").when(F.col("score") >= 0.5, "PARTIAL").otherwise("NON-COMPLIANT").alias("status"), percent_text(F.col("ratio")).alias("ratio_text"))


def anomaly_detection(rate: Column, enabled: Column) -> tuple[Column, Column]:
    score = F.when(~enabled, 0.0).when((rate >= 5) & (rate <= 15), 1.0).when(rate < 5, 0.6).otherwise(0.7)
    return score, F.when(score >= 1.0, "COMPLIANT").when(score > 0, "PARTIAL").otherwise("NON-COMPLIANT")


CONFIG = "site string, auth boolean, mfa boolean, logging boolean, siem boolean, retention_days int, rbac boolean, least_privilege boolean, checksums boolean, signing boolean, detection boolean, target_sl string"


# fixed values: the scores
def site_scores(config: DataFrame) -> DataFrame:
    """Scores of four requirements from a table of sites."""
    c = F.col
    return config.select(
        "site", "target_sl", F.when(~c("auth"), 0.0).when(c("mfa"), 1.0).otherwise(0.6).alias("authentication"),
        F.when(~c("logging"), 0.0).when(c("siem") & (c("retention_days") >= 90), 1.0).when(c("retention_days") >= 90, 0.7).otherwise(0.5).alias("logging"),
        F.when(c("rbac") & c("least_privilege"), 1.0).when(c("rbac"), 0.7).otherwise(0.3).alias("access_control"),
        F.when(c("checksums") & c("signing"), 1.0).when(c("checksums") | c("signing"), 0.6).otherwise(0.2).alias("data_integrity"), "detection",
    )


def compliance_report(config: DataFrame, segmentation_score: DataFrame, anomaly_rate: DataFrame) -> DataFrame:
    """Per site: mean of six scores, level, and a recommendation against its target."""
    held = site_scores(config).crossJoin(F.broadcast(segmentation_score.select(F.col("score").alias("segmentation")))).crossJoin(F.broadcast(anomaly_rate.select("rate")))
    held = held.withColumn("anomaly_detection", anomaly_detection(F.col("rate"), F.col("detection"))[0])
    names = ["segmentation", "anomaly_detection", "authentication", "logging", "access_control", "data_integrity"]
    mean = sum((F.col(n) for n in names), F.lit(0.0)) / 6
    level = F.when(F.col("overall") >= 0.95, "SL-4").when(F.col("overall") >= 0.80, "SL-3").when(F.col("overall") >= 0.60, "SL-2").when(F.col("overall") >= 0.40, "SL-1").otherwise("Below SL-1")
    good = sum((F.when(F.col(n) >= 0.8, 1).otherwise(0) for n in names), F.lit(0))
    return held.withColumn("overall", mean).select("site", *names, "overall", level.alias("level"), good.alias("compliant"), (level >= F.col("target_sl")).alias("meets_target"))


def compliance_gaps(report: DataFrame) -> DataFrame:
    names = ["segmentation", "anomaly_detection", "authentication", "logging", "access_control", "data_integrity"]
    return report.unpivot(["site"], names, "requirement", "score").orderBy("score", "site", "requirement")


def zones(spark: SparkSession) -> DataFrame:
    return rows(spark, ZONES, "level int, zone string")


# --- intelligence ------------------------------------------------------------------------


def _stix_id(kind: str, *parts) -> Column:
    h = F.sha2(F.concat_ws("|", F.lit(kind), *parts), 256)
    return F.concat(F.lit(f"{kind}--"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12)))


def stix_objects(summary: DataFrame, author: str = "otflow") -> DataFrame:
    """(type, id, body): identity, indicators, attack patterns (one a technique), and relationships of detected patterns known to the exporters."""
    spark = summary.sparkSession
    dim = mitre(spark)
    known = summary.where("detected").join(F.broadcast(dim), "pattern")
    ident = spark.range(1).select(F.lit("identity").alias("type"), _stix_id("identity", F.lit(author)).alias("id"), F.to_json(F.struct(F.lit(author).alias("name"), F.lit("system").alias("identity_class"))).alias("body"))
    indicator = known.select(F.lit("indicator").alias("type"), _stix_id("indicator", "pattern").alias("id"), F.to_json(F.struct(title(F.col("pattern")).alias("name"), "severity", "confidence", "n_flows")).alias("body"))
    first = known.withColumn("turn", F.row_number().over(Window.partitionBy("technique_id").orderBy("ord"))).where("turn = 1")
    attack = first.select(F.lit("attack-pattern").alias("type"), _stix_id("attack-pattern", "technique_id").alias("id"), F.to_json(F.struct(F.col("technique_name").alias("name"), "tactic", "technique_id")).alias("body"))
    link = known.select(F.lit("relationship").alias("type"), _stix_id("relationship", "pattern", "technique_id").alias("id"), F.to_json(F.struct(_stix_id("indicator", "pattern").alias("source_ref"), F.lit("indicates").alias("relationship_type"), _stix_id("attack-pattern", "technique_id").alias("target_ref"))).alias("body"))
    return ident.unionByName(indicator).unionByName(attack).unionByName(link)


# fixed values: what a rule's payload must hold, and its threshold
_MATCH = [("modbus_flooding", "|00 00|", "|01|", "threshold:type threshold, track by_src, count 100, seconds 1;"), ("plc_scanning", "", "|01|", "threshold:type threshold, track by_src, count 50, seconds 10;"), ("unauthorized_write", "", "|06|", ""), ("man_in_the_middle", "", "", "ttl:128;"), ("replay_attack", "", "|03|", "threshold:type threshold, track by_src, count 20, seconds 1;"), ("command_injection", "", "|06|", "")]


def rule_text(summary: DataFrame) -> DataFrame:
    """(sid, rule) of detected patterns that have one; writes also get the rule for function 16, 50 above."""
    spark = summary.sparkSession
    dim = rows(spark, RULES, "pattern string, sid long, classtype string, priority int").join(rows(spark, _MATCH, "pattern string, head string, function string, extra string"), "pattern")
    known = summary.where("detected").select("pattern").join(F.broadcast(dim), "pattern")
    more = known.where("pattern = 'unauthorized_write'").withColumns({"sid": F.col("sid") + 50, "function": F.lit("|10|")})
    content = lambda c: F.when(c != "", F.concat(F.lit(' content:"'), c, F.lit('";'))).otherwise("")
    text = F.concat(F.lit('alert tcp any any -> any 502 (msg:"'), title(F.col("pattern")), F.lit('";'), content(F.col("head")), content(F.col("function")), F.when(F.col("extra") != "", F.concat(F.lit(" "), "extra")).otherwise(""), F.format_string(" classtype:%s; priority:%d; sid:%d; rev:1;)", F.col("classtype"), F.col("priority"), F.col("sid")))
    return known.unionByName(more).select("sid", "pattern", text.alias("rule")).dropDuplicates(["sid"])


# --- requests ----------------------------------------------------------------------------


def valid_ip(c: Column) -> Column:
    parts = F.split(c, r"\.")
    return (F.size(parts) == 4) & F.forall(parts, lambda p: F.coalesce(F.rlike(p, F.lit("^[0-9]{1,3}$")) & (F.try_to_number(p, F.lit("999")) <= 255), F.lit(False)))


def validate(requests: DataFrame) -> DataFrame:
    """``requests`` with ``valid``: ports, protocol, counts and addresses in range."""
    c = F.col
    counts = [c(n) >= 0 for n in ("fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes")]
    ok = c("src_port").between(0, 65535) & c("dst_port").between(0, 65535) & c("protocol").between(0, 255) & valid_ip(c("src_ip")) & valid_ip(c("dst_ip"))
    for x in counts:
        ok = ok & x
    return requests.withColumn("valid", F.coalesce(ok, F.lit(False)))
