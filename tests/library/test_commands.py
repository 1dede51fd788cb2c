import json

import pytest
from pyspark.sql import functions as F

from lectern.__main__ import main
from lectern.plans import runs
from lectern.sources.artifacts import published
from tests.library.test_sources import ATOM, OAI

FOLDER = "/root/testdata/sf0.001"


def test_queries_and_searches(spark, tmp_path, capsys):
    assert main(["query", "category_counts", FOLDER]) == 0 and "English" in capsys.readouterr().out
    papers = spark.createDataFrame([(1, "kelp", "farms at sea"), (2, "wind", "kites")], "paper_id long, title string, abstract string").selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' AS published_utc")
    papers.write.parquet(str(tmp_path / "papers"))
    assert main(["index", str(tmp_path / "papers"), str(tmp_path / "index")]) == 0
    assert main(["search", str(tmp_path / "index"), "kelp farms"]) == 0
    assert main(["search", str(tmp_path / "index"), "nothing like it"]) == 1
    for wrong in (["query", "no such", FOLDER], ["search", str(tmp_path / "none"), "x"], ["dance"], []):
        with pytest.raises(SystemExit) as error:
            main(wrong)
        assert error.value.code == 2


def test_ingest_and_evaluate(spark, tmp_path, capsys):
    (tmp_path / "a.xml").write_text(ATOM)
    args = ["ingest", str(tmp_path / "a.xml"), *(str(tmp_path / x) for x in ("pages", "table", "check"))]
    assert main(args) == 0 and main(args) == 0
    assert "2" in capsys.readouterr().out
    spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query_id string, paper_id long, rank int").write.parquet(str(tmp_path / "ranked"))
    spark.createDataFrame([("q", 2, 3, "pool")], "query_id string, paper_id long, grade int, source string").write.parquet(str(tmp_path / "judged"))
    assert main(["evaluate", str(tmp_path / "ranked"), str(tmp_path / "judged"), "0.6"]) == 0
    assert main(["evaluate", str(tmp_path / "ranked"), str(tmp_path / "judged"), "0.7"]) == 1


def counts(ids):
    return [None if k.endswith("3") else {"citation_count": int(k[-1]), "influential_citation_count": 1, "github_stars": None} for k in ids]


def answers(passages):
    kinds = {f: 1 for f in ("feasibility_score", "goal_alignment_score", "composite_score")}
    names = "summary feasibility_score hard_blockers learning_bridge estimated_effort approach approach_rationale reference_code_likelihood goal_alignment_score resume_signal extension_idea required_skills composite_score".split()
    return [json.dumps({n: kinds.get(n, ["x"] if n in ("hard_blockers", "required_skills") else "x") for n in names}) if "kelp" in p else "{}" for p in passages]


def test_bulk_goes_on_where_it_stopped(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    other = OAI.replace("2401.1<", "2401.2<").replace("2024-01-02", "2024-03-02").replace("cs.LG  stat.ML", "math.CO")
    page = lambda name, token, following, body: (tmp_path / "pages" / name).write_text(json.dumps({"token": token, "next": following, "body": body}) + "\n")
    page("a", "", "t1", OAI)
    args = ["bulk", str(tmp_path / "pages"), str(tmp_path / "base"), "--from", "2024-01-01"]
    assert main(args) == 0
    page("b", "t1", None, other)
    table = runs.bulk(spark, args[1], args[2], "2024-01-01")
    assert sorted(r.arxiv_id for r in table.collect()) == ["2401.1", "2401.2"]
    late = runs.bulk(spark, args[1], str(tmp_path / "late"), "2024-02-01")
    assert [r.arxiv_id for r in late.collect()] == ["2401.2"]
    of_set = runs.bulk(spark, args[1], str(tmp_path / "set"), "2024-01-01", "cs")
    assert [r.arxiv_id for r in of_set.collect()] == ["2401.1"]
    (tmp_path / "none").mkdir()
    assert runs.bulk(spark, str(tmp_path / "none"), str(tmp_path / "empty"), "2024-01-01").count() == 0
    for wrong in (args[:3], [*args[:4], "soon"], [*args, "--fetch", "no.such:thing"]):
        with pytest.raises(SystemExit) as error:
            main(wrong)
        assert error.value.code == 2


def test_embed_enrich_and_analyze(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    rows = [(k, f"2401.0000{k}", t, "at sea") for k, t in enumerate(["kelp farms", "wind", "kelp", "salt", None])]
    papers = spark.createDataFrame(rows, "paper_id long, arxiv_id string, title string, abstract string")
    papers.where("paper_id < 3").write.parquet(at("some"))
    papers.write.parquet(at("papers"))
    spark.createDataFrame([(k, c) for k in range(4) for c in ("sea", "sea", f"c{k}")], "paper_id long, category string").write.parquet(at("tags"))
    assert main(["embed", at("some"), at("vectors"), "m1"]) == 0 and "3 embedded, 3 in all" in capsys.readouterr().out
    assert main(["embed", at("papers"), at("vectors"), "m1"]) == 0 and "2 embedded, 5 in all" in capsys.readouterr().out
    assert main(["embed", at("papers"), at("vectors"), "m1"]) == 0 and "0 embedded, 5 in all" in capsys.readouterr().out
    blocks, embedded = runs.embed(papers, at("vectors"), "m2", lambda texts: [[1.0, float(len(t))] for t in texts])
    assert embedded == 5 and published(spark, at("vectors/rows")).where("model_version <> 'm2'").isEmpty()

    call = ["--call", "tests.library.test_commands:counts"]
    assert main(["enrich", at("some"), at("signals"), "2024-05-01", *call]) == 0 and "3 asked for, 3 answered" in capsys.readouterr().out
    assert main(["enrich", at("papers"), at("signals"), "2024-05-10", *call]) == 0 and "2 asked for, 1 answered" in capsys.readouterr().out
    assert main(["enrich", at("papers"), at("signals"), "2024-05-20", *call]) == 0 and "4 asked for, 3 answered" in capsys.readouterr().out
    found = {r.paper_id: (r.citation_count, r.fetched_utc.day) for r in published(spark, at("signals")).collect()}
    assert found == {0: (0, 20), 1: (1, 20), 2: (2, 20), 4: (4, 10)}

    asked = ["analyze", at("papers"), at("tags"), at("analyses"), "sea", "2024-05-01", "m", "--call", "tests.library.test_commands:answers"]
    assert main(asked) == 1 and "4 asked for, 2 stored" in capsys.readouterr().out
    assert main(asked) == 1 and "2 asked for, 0 stored" in capsys.readouterr().out
    assert sorted(r.paper_id for r in published(spark, at("analyses")).collect()) == [0, 2]
    every, n, kept = runs.analyze(papers.withColumn("title", F.lit("kelp")), spark.read.parquet(at("tags")), at("analyses"), "sea", "2024-06-01 00:00:00", "m", answers, None, 2)
    assert (n, kept) == (4, 4) and {(r.paper_id, r.profile_version) for r in every.collect()} == {(k, 2) for k in range(4)}
    for wrong in (["enrich", at("some"), at("signals"), "2024-05-01"], ["analyze", *asked[1:-1], "nothing"], ["embed", at("some"), at("v"), "m", "--call", "no:thing"]):
        with pytest.raises(SystemExit) as error:
            main(wrong)
        assert error.value.code == 2
