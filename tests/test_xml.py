"""Structure of XML files: row element, collapse and schema from the files themselves."""

from __future__ import annotations

from rowsmith.operators import reshape
from rowsmith.sources import documents
from tests.conftest import rows


def write(folder, **files):
    for name, content in files.items():
        (folder / f"{name}.xml").write_text(content)
    return str(folder)


def test_a_repeated_child_is_the_table(spark, tmp_path):
    path = write(
        tmp_path,
        a='<catalog><book id="1"><title>A</title><tag>x</tag><tag>y</tag></book><book id="2" lang="en"><title>B</title></book></catalog>',
        b="<catalog>\n  <book><title>C</title><by><first>F</first></by></book>\n</catalog>",
    )
    found = documents.read_xml(spark, path)
    assert list(found.tables) == ["books"] and found.warnings == ()
    flat = reshape.flatten(found.tables["books"], "record").select("attr_id", "attr_lang", "title", "tag", "by__first")
    assert sorted(rows(flat), key=str) == [
        ("1", None, "A", '["x","y"]', None), ("2", "en", "B", None, None), (None, None, "C", None, "F"),
    ]


def test_other_roots_are_one_record(spark, tmp_path):
    path = write(tmp_path, a='<note to="x">text <b>bold</b> more</note>', b="<point><x>1</x><y>2</y></point>", c="<points><p>1</p><p>2</p></points>")
    found = documents.read_xml(spark, path)
    assert set(found.tables) == {"note", "point", "ps"}
    assert rows(reshape.flatten(found.tables["point"], "record")) == [("1", "2")]
    note = reshape.flatten(found.tables["note"], "record")
    assert note.columns == ["attr_to", "text", "b"] and note.select("attr_to", "b").first() == ("x", "bold")
    assert sorted(r["record"] for r in found.tables["ps"].collect()) == ["1", "2"]


def test_records_that_one_file_has_once(spark, tmp_path):
    path = write(tmp_path, a="<people><person><n>1</n></person></people>", b="<people><person><n>2</n></person><person><n>3</n></person></people>")
    people = documents.read_xml(spark, path).tables["people"] if "people" in documents.read_xml(spark, path).tables else None
    table = people if people is not None else documents.read_xml(spark, path).tables["persons"]
    assert sorted(rows(reshape.flatten(table, "record"))) == [("1",), ("2",), ("3",)]


def test_namespaces_broken_and_empty_files(spark, tmp_path):
    path = write(
        tmp_path, a='<e:envelope xmlns:e="u"><e:row e:k="1">v</e:row><e:row>w</e:row></e:envelope>', b="<open><x>", c="<rows/>",
    )
    found = documents.read_xml(spark, path)
    assert found.warnings == ("1 file(s) are not well-formed XML and were left out",)
    assert sorted(rows(reshape.flatten(found.tables["rows"], "record")), key=str) == [("1", "v"), (None, "w")]


def test_path_trees_of_files_merge(spark, tmp_path):
    path = write(tmp_path, **{f"f{i}": f"<r><a><b>{i}</b>{'<c/>' * i}</a></r>" for i in range(4)})
    tree = documents.xml_paths(spark, path).groupBy("path").agg({"repeats": "max", "file": "count"}).collect()
    assert {(tuple(r["path"]), r["max(repeats)"], r["count(file)"]) for r in tree} == {
        (("r",), 1, 4), (("r", "a"), 1, 4), (("r", "a", "b"), 1, 4), (("r", "a", "c"), 3, 3),
    }
    record = documents.read_xml(spark, path).tables["r"].select("record.a.*")
    assert dict(record.dtypes) == {"b": "string", "c": "array<string>"}
