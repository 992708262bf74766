"""Arrays cut into byte ranges give the same elements as a JSON parser, wherever the cuts fall."""

import json
import random

import pytest

from wareloom.sources.captures import read_page_list
from wareloom.sources.page_lists import read_array


def awkward(r):
    text = "".join(r.choices(['"', "\\", "}", "{", "[", "]", ",", "é", "\n", "a", "null", "\\\""], k=r.randint(0, 9)))
    entry = {"loc": f"https://a/{r.randint(0, 9)}{text}"}
    if r.random() < 0.4:
        entry["extra"] = {"deep": [{"}": text}, [], [text, {"x": {}}]], text: None}
    if r.random() < 0.3:
        entry = {"extra": entry.get("extra"), "lastmod": text, "loc": r.choice(["", None, entry["loc"]])}
    return None if r.random() < 0.1 else entry


def listed(spark, path):
    return [(r.url, r.cand_ord) for r in read_page_list(spark, path).orderBy("cand_ord").collect()]


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("seed", range(4))
def test_any_cut_gives_the_elements(spark, run_dir, small_ranges, seed):
    r = random.Random(seed)
    expected = []
    for number in range(3):
        entries = [awkward(r) for _ in range(r.choice([0, 1, 60]))]
        with open(f"{run_dir}/{number}.json", "w") as out:
            json.dump(entries, out, indent=r.choice([None, 1]), ensure_ascii=r.random() < 0.5)
        expected += [entry["loc"] for entry in entries if entry and entry.get("loc")]
    assert listed(spark, run_dir) == list(zip(expected, range(len(expected))))


def test_one_file_is_read_by_many_tasks(spark, run_dir, small_ranges):
    entries = [{"loc": f"https://a/{i}"} for i in range(200)]
    with open(run_dir + "/one.json", "w") as out:
        json.dump(entries + [{"loc": "https://long/" + "x}" * 500}], out)
    assert read_array(spark, run_dir + "/one.json").rdd.getNumPartitions() > 60
    urls = [url for url, _ in listed(spark, run_dir + "/one.json")]
    assert urls == [entry["loc"] for entry in entries] + ["https://long/" + "x}" * 500]


BAD = ['[{"loc": "a"} {"loc": "b"}]', '[,{"loc": "a"}]', '[{"loc": "a"', '[{"loc": "a"}', '{"loc": "a"}', '[{"loc": "a"}] x', '[1, {"loc": "a"}]', '[{"loc": "a"} {"loc": 1 }}]', "", '[{"loc": "a"}, "b"]', '["a"]', '[{"loc": }]']


@pytest.mark.parametrize("text", BAD)
def test_what_is_no_array_of_objects_is_an_error(spark, run_dir, text):
    with open(run_dir + "/bad.json", "w") as out:
        out.write(text)
    if not text:
        assert listed(spark, run_dir + "/bad.json") == []
        return
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        listed(spark, run_dir + "/bad.json")
