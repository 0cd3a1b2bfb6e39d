"""Front matter by the compiled parser, against the library's own."""

import pytest
import yaml

from tallyloom.functions import front
from tallyloom.sources.adapters import TEXTS, relation

TEXT = [
    "", "{}", "a: 1\nb: yes\nc: 'x: y'\nd: 2024-01-02\ne: [1, {f: 2}]", "a: *none", "a: &x 1\nb: *x", "a: b: c", "a:\tb", "\ta: b", "- a\n- b", "just text", "a: |\n  x\n  y\n", "a: 1\na: 2", "a: 0x1F\nb: 1e3\nc: .inf\nd: ~", "标题: 值\nx: é",
    "a: 2024-99-99", "a: !!python/object:os.system x", "%TAG", "a: \x07", "a: \x85b", "k: " + "[" * 30 + "]" * 30, "? a\n: b", "a: '", "a #b: c", "a: b #c", "@a: 1", "a: 12:30:45", "<<: {a: 1}\nb: 2", "a\xa0b: c", "a: 1\r\nb: 2",
]


def told(read, text):
    try:
        return "value", read(text)
    except Exception as error:
        return "error", str(error)


@pytest.mark.parametrize("text", TEXT)
def test_same_values_and_errors(text):
    assert told(front.loaded, text) == told(yaml.safe_load, text) == told(front.loaded, text)


def test_equal_texts_are_read_once(monkeypatch):
    text, real, seen = "kept: once\nn: 1", yaml.CSafeLoader, []
    monkeypatch.setattr(yaml, "CSafeLoader", lambda stream: seen.append(stream) or real(stream))
    assert [front.loaded(text) for _ in range(5)] == [{"kept": "once", "n": 1}] * 5
    assert len(seen) == 1


@pytest.mark.parametrize("name", TEXTS)
def test_small_tables_are_work_for_all_cores(spark, name):
    assert relation(spark, "/root/testdata/sf0.001", name).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
