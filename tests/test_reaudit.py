"""Audits from facts against audits from texts, after edits, deletions and new files."""

import pytest
from oracle import SMALL, rows_of
from pyspark.sql import functions as F

from dossierlake.functions.lexicon import DEFAULT
from dossierlake.plans import reaudit
from dossierlake.plans.audit import AuditFrames, AuditOptions
from dossierlake.plans.driver import PROSE, driver_corpus
from dossierlake.plans.whole_audit import TRACK, driver_inventory
from dossierlake.workspace import materialize


def same(ours, theirs):
    assert rows_of(ours.toPandas()) == rows_of(theirs.toPandas())


def test_edits_deletions_and_new_files(spark):
    options = AuditOptions(lexicon=PROSE, track=TRACK)
    inventory, corpus = driver_inventory(spark, SMALL), driver_corpus(spark, SMALL)
    is_new, is_gone, is_edited = F.col("path") < "0000000009", F.col("path").between("0000000020", "0000000024"), F.col("path").endswith("7.md")
    old, old_assets = materialize(corpus.where(~is_new), "old"), inventory.where(~is_new)
    before = reaudit.first_audit(old_assets, old, options)
    edited = corpus.where(is_edited | is_new).withColumn("text", F.when(is_edited, F.concat("text", F.lit("\nversion = 3 token"))).otherwise(F.col("text")))
    unchanged = corpus.where(F.col("path") == "0000000100.md")
    changes, gone = edited.unionByName(unchanged), corpus.where(is_gone).select("project_id", "path")
    assets = materialize(inventory.where(~is_gone), "now")
    after, touched = reaudit.reaudit(before, assets, changes, options, gone)
    now = corpus.where(~is_gone & ~is_edited & ~is_new).unionByName(edited.where(~is_gone))
    want = AuditFrames(assets, materialize(now, "now"), options)
    same(after.claims, want.claims)
    same(after.evidence, want.evidence)
    same(after.scores.drop("dimensions"), want.scores.drop("dimensions"))
    names = {r.project_id for r in touched.collect()}
    owners = {r.project_id for r in edited.select("project_id").union(gone.select("project_id")).distinct().collect()}
    assert names == owners and unchanged.first().project_id not in names or unchanged.first().project_id in owners
    assert after.facts.files.count() == now.count()


def test_an_edit_of_nothing_touches_nothing(spark):
    options = AuditOptions(lexicon=PROSE, track=TRACK)
    assets, corpus = materialize(driver_inventory(spark, SMALL), "a"), materialize(driver_corpus(spark, SMALL).limit(50), "c")
    before = reaudit.first_audit(assets, corpus, options)
    after, touched = reaudit.reaudit(before, assets, corpus, options)
    assert touched.count() == 0
    same(after.scores.drop("dimensions"), before.scores.drop("dimensions"))


def test_partners_and_types_come_from_given_texts(spark):
    files = [
        ("p", "plan.md", "BUSINESS_PLAN", "# 计划\n我们与启明科技有限公司签署了合作协议，合同编号 2024001\n目标用户：学生"),
        ("p", "proof.md", "PROOF_MATERIAL", "启明科技有限公司 合同 2024001 盖章"),
        ("p", "other.md", "PROOF_MATERIAL", "别的公司 合同 2024001"),
        ("q", "plan.md", "BUSINESS_PLAN", None),
    ]
    corpus = spark.createDataFrame([(p, n, "EXTRACTED_TEXT", t) for p, n, _, t in files], "project_id string, path string, status string, text string")
    assets = spark.createDataFrame([(p, n, r, True, False, False, False) for p, n, r, _ in files], "project_id string, path string, role string, auditable boolean, sensitive boolean, generated boolean, vendored boolean")
    options = AuditOptions(lexicon=DEFAULT)
    facts = reaudit.facts_of(corpus, assets, DEFAULT)
    ours, theirs = reaudit.FactAudit(assets, facts, options, corpus), AuditFrames(assets, corpus.fillna("", ["text"]), options)
    assert theirs.claims.count() > 0
    for stage in ("claims", "evidence", "profile", "issues", "findings"):
        same(getattr(ours, stage), getattr(theirs, stage))
    with pytest.raises(ValueError, match="partners"):
        reaudit.FactAudit(assets, facts, AuditOptions(lexicon=DEFAULT, track=TRACK)).evidence
    with pytest.raises(ValueError, match="track"):
        reaudit.FactAudit(assets, facts, options).types


def test_no_text_goes_into_a_join(spark):
    """The facts of texts that come without statuses: joins stand above the lines, so no text is in one."""
    from dossierlake.plans.driver import driver_statuses, driver_texts

    assets, texts, statuses = driver_inventory(spark, SMALL), driver_texts(spark, SMALL), driver_statuses(spark, SMALL)
    facts, whole = reaudit.facts_of(texts, assets, PROSE, statuses), reaudit.facts_of(driver_corpus(spark, SMALL), assets, PROSE)
    for part in ("files", "statements", "fields", "features"):
        same(getattr(facts, part), getattr(whole, part))
        if part in ("statements", "fields"):
            above, _, below = getattr(facts, part)._jdf.queryExecution().optimizedPlan().toString().partition("posexplode(")
            assert below and "Join" in above and "Join" not in below.split("Relation")[0]


@pytest.mark.parametrize("lexicon", [PROSE, DEFAULT])
def test_the_first_look_at_a_line_leaves_none_out(spark, lexicon):
    import random

    from dossierlake.functions.text import trimmed, without_markdown
    from dossierlake.operators import claims, profile

    rng = random.Random(3)
    words = [w for k in lexicon.claim_types for w in k.topics + k.signs] + [w for own in lexicon.profile_labels.values() for w in own]
    words = [*words, *map(str.upper, words), ":", "：", "是", " ", "# ", "- ", "7", "x", "é", "\t"]
    rows = [("".join(rng.choice(words) for _ in range(rng.randint(0, 5))),) for _ in range(3000)]
    lines = spark.createDataFrame(rows, "raw string").select("raw", trimmed(F.col("raw")).alias("head"))
    lines = lines.withColumn("line", without_markdown(F.col("head")))
    stated = lines.where(claims.claim_type(F.col("head"), lexicon).isNotNull())
    assert stated.count() > 50 and stated.where(~claims.may_state(F.col("raw"), lexicon)).count() == 0
    filled = lines.where((F.size(profile.labels_found(F.col("line"), lexicon.profile_labels)) > 0) | F.col("head").startswith("# "))
    assert filled.count() > 50 and filled.where(~profile.may_fill(F.col("raw"), lexicon.profile_labels)).count() == 0
