"""Support of claims: boundaries, units, negation, full width, scope by field, major and cited document."""

from pyspark.sql import functions as F

from quillmill.operators import evaluate, ground

ANSWERS = "query_id long, answer string"
EVIDENCE = "query_id long, rank int, text string, source_file string, heading_path string"
SOFTWARE = ("毕业学分要求：166 学分。第二课堂学分要求：7 学分。", "2024软件工程培养计划.pdf")
COMPUTING = ("毕业学分要求：１６６ 学分。第二课堂学分要求：6 学分。", "2024计算机科学与技术培养计划.pdf")
# Answers, their evidence as (text, file), and whether all claims are supported.
VERIFIED = [
    ("毕业需要6学分。", [("毕业总计166学分。", "")], False), ("需要6学分。", [("最低要求16.6学分。", "")], False), ("需要20学分。", [("奖学金金额20元。", "")], False),
    ("毕业不需要166学分。", [("毕业需要166学分。", "")], False), ("毕业不需要166学分。", [("毕业不需要166学分。", None)], True),
    ("软件工程专业毕业需修满166学分[1]。", [SOFTWARE, COMPUTING], True), ("软件工程第二课堂要求166学分[1]。", [SOFTWARE, COMPUTING], False),
    ("计算机科学与技术第二课堂要求7学分。", [SOFTWARE, COMPUTING], False), ("计算机科学与技术毕业要求166学分，第二课堂要求7学分。", [SOFTWARE, COMPUTING], False),
    ("计算机科学与技术毕业要求166学分，第二课堂要求6学分。", [SOFTWARE, COMPUTING], True), ("计算机科学与技术专业毕业需修满166学分[1]。", [SOFTWARE, COMPUTING], False),
    ("计算机科学与技术专业毕业需修满166学分[2]。", [SOFTWARE, COMPUTING], True), ("计算机科学与技术和软件工程的毕业总学分相同，均为166学分[1][2]。", [SOFTWARE, COMPUTING], True),
    ("计算机科学与技术和软件工程的毕业总学分相同，均为166学分[1]。", [SOFTWARE, COMPUTING], False), ("必须通过资格审核", [("申请人不必通过资格审核。", "")], False),
    ("不必通过资格审核。", [("申请人不必通过资格审核。", "")], True), ("毕业160学分[2]。", [("毕业160学分。", ""), ("毕业161学分。", "")], False), ("", [], True), (None, [], True), ("前10%", [], False),
]
# Fixed values: (expected value, answer, stated).
VALUES = [
    ("6学分", "需要６ 学分。", True), ("6学分", "毕业需166学分", False), ("166学分", "毕业需１６６ 学分", True), ("25元", "25元每小时", False), ("25元", "补助25元", True), ("20学分", "金额为20元。", False),
    ("3.5", "绩点3.55", False), ("3.8", "绩点为13.8。", False), ("10%", "前10%", True), ("20学分", "不需要20学分。", False), ("软件工程专业必修20学分", "网络工程专业必修20学分。", False),
    ("软件工程毕业166学分", "软件工程第二课堂166学分。", False), ("软件工程毕业166学分", "软件工程专业毕业166学分", True), ("软件工程毕业166学分", "网络工程专业毕业166学分", False),
    ("软件工程毕业166学分", "软件工程专业要求如下，毕业166学分", True), ("毕业166学分", "通识166学分", False), ("", "任何", False), ("(a.b)", "见(a.b)段", True), ("(a.b)", "见(aab)段", False),
]
CONDITIONS = [
    ("必须通过资格审核", "申请人必须通过资格审核。", True), ("必须通过资格审核", "申请人不必通过资格审核。", False), ("必须通过资格审核", "并非必须通过资格审核。", False),
    ("通过资格审核", "未通过资格审核。", False), ("有处分", "有处分者取消", True), ("处分", "没有处分", False), ("前10", "前100名", False),
]


def test_claims_against_evidence(spark):
    answers = spark.createDataFrame([(i, a) for i, (a, _, _) in enumerate(VERIFIED)], ANSWERS)
    evidence = spark.createDataFrame([(i, k, t, f, "") for i, (_, docs, _) in enumerate(VERIFIED) for k, (t, f) in enumerate(docs, 1)], EVIDENCE)
    got = {r.query_id: r for r in ground.verify(answers, evidence).collect()}
    assert {i: r.hallucination_count == 0 for i, r in got.items()} == {i: ok for i, (_, _, ok) in enumerate(VERIFIED)}
    assert [(c.claim_text, c.claim_type) for c in got[9].checks] == [("166学分", "value"), ("6学分", "value")] and got[18].total_claims == 0
    assert ground.verify(answers.limit(0), evidence).count() == 0


def test_claims_in_order_with_conditions(spark):
    answers = spark.createDataFrame([(1, "绩点不低于 3.0，前10%且无不及格。补助25元，前10%可申请。")], ANSWERS)
    checks = ground.verify(answers, spark.createDataFrame([(1, 1, "前10%可申请。", "", "")], EVIDENCE)).first().checks
    assert [c.claim_text for c in checks if c.claim_type == "value"] == ["绩点不低于3.0", "前10%", "25元", "前10%"]
    assert [c.claim_text for c in checks if c.claim_type == "condition"] == ["绩点不低于3.0", "10%且无不及格", "前10%且无不及格", "前10%可申请"]
    assert checks[-1].claim_text == "前10%可申请" and checks[-1].matched and not any(c.matched for c in checks if "及格" in c.claim_text)


def test_expected_values_and_conditions(spark):
    cases = [("v", *c) for c in VALUES] + [("c", *c) for c in CONDITIONS]
    rows = [(i, a, [e] if k == "v" else [], [e] if k == "c" else None) for i, (k, e, a, _) in enumerate(cases)]
    got = evaluate.score_answers(spark.createDataFrame(rows, ANSWERS + ", expected_values array<string>, expected_conditions array<string>"))
    hits = {r.query_id: r.h for r in got.select("query_id", (F.col("values_hit") + F.col("conditions_hit")).alias("h")).collect()}
    assert hits == {i: int(c[-1]) for i, c in enumerate(cases)}


def test_lookup(spark):
    q = spark.createDataFrame([(1, "软件工程专业毕业需要多少学分？"), (2, "2022级软件工程毕业学分是多少"), (3, "怎么请假")], "query_id long, query string")
    c = spark.createDataFrame([("2023软件工程专业培养计划.pdf", "毕业学分要求：165.5 学分"), ("2023软件工程专业培养计划.pdf", "第二课堂 6 学分")], "source_file string, text string")
    assert {tuple(r) for r in ground.lookup_totals(q, c).collect()} == {(1, "165.5", "found"), (2, None, "ambiguous")}
