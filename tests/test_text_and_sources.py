"""Token rules, delimited readers and the workbook reader on hand-made fixtures."""

import os
import re
import zipfile

import pytest

from lexiframe.functions.text import join_columns, whitespace_tokens, word_tokens
from lexiframe.sources import delimited as dl
from lexiframe.sources.workbook import read_sheet

SAMPLES = [
    "Hello, World! a b cd_ef 42 x7",
    "नमस्ते दुनिया यह एक परीक्षण है",
    "สวัสดีชาวโลก ทดสอบ",
    "Ça va? Élan, naïve café — déjà vu",
    "tab\tsep\nnew  line  e  é 9 99",
    "",
]


def test_word_tokens_match_python_rule(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string")
    got = {r.i: r.t for r in df.select("i", word_tokens("s").alias("t")).collect()}
    for i, s in enumerate(SAMPLES):
        assert got[i] == re.findall(r"(?u)\b\w\w+\b", s.lower()) or \
            got[i] == [t for t in re.findall(r"[^\W]+", s.lower()) if len(t) >= 2], (s, got[i])


def test_whitespace_split_matches_str_split(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string")
    got = {r.i: r.t for r in df.select("i", whitespace_tokens("s").alias("t")).collect()}
    for i, s in enumerate(SAMPLES):
        assert got[i] == s.split()


def test_join_columns_prints_missing_as_nan(spark):
    df = spark.createDataFrame([("a", None, "c")], "x string, y string, z string")
    assert df.select(join_columns(["x", "y", "z"], " [SEP] ", "nan").alias("t")).first().t == "a [SEP] nan [SEP] c"


def test_csv_quotes_newlines_na(spark, tmp_dir):
    path = os.path.join(tmp_dir, "f.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write('QUOTE,RATING\n"a ""q"" b",FAKE\n"line one\nline two",FALSE\nNA,TRUE\n,MISLEADING\n')
    df = dl.read_csv(spark, path, ["QUOTE", "RATING"], with_position="pos", multi_line=True)
    rows = sorted(df.collect(), key=lambda r: r.pos)
    assert [r.pos for r in rows] == [0, 1, 2, 3]
    assert rows[0].QUOTE == 'a "q" b'
    assert rows[1].QUOTE == "line one\nline two"
    assert rows[2].QUOTE is None and rows[3].QUOTE is None
    assert [r.RATING for r in rows] == ["FAKE", "FALSE", "TRUE", "MISLEADING"]


def test_liar_headerless_layout(spark, tmp_dir):
    path = os.path.join(tmp_dir, "liar.tsv")
    cells = ["1.json", "false", "Says x.", "tax", "bob", "", "TX", "rep", "1", "", "0", "2", "3", "a speech"]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\t".join(cells) + "\n")
    df = dl.read_liar(spark, path)
    text = df.select(join_columns(list(dl.LIAR_COLUMNS[2:]), " [SEP] ", "nan").alias("t")).first().t
    assert text == "Says x. [SEP] tax [SEP] bob [SEP] nan [SEP] TX [SEP] rep [SEP] 1 [SEP] nan [SEP] 0 [SEP] 2 [SEP] 3 [SEP] a speech"


def test_unterminated_quote_is_caught_by_row_count(spark, tmp_dir):
    path = os.path.join(tmp_dir, "bad.tsv")
    with open(path, "w", encoding="utf-8") as f:
        f.write('claim\tlabel\n"open quote\ttrue\nnext\tfalse\nlast\tother\n')
    df = dl.read_tsv(spark, path, ["claim", "label"], multi_line=True, malformed="keep").select("claim", "label")
    with pytest.raises(Exception):
        dl.check_row_count(df, 3).collect()


def _xlsx(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rel}><sheets><sheet name="rated_with_quotes" '
                                      f'sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Target="worksheets/sheet1.xml" Type="x"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst {ns}><si><t>RATING</t></si><si><t>QUOTE 1</t></si>'
                                           f'<si><t>FAKE</t></si><si><t>first quote</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml",
                   f'<worksheet {ns}><sheetData>'
                   '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>'
                   '<row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2" t="s"><v>3</v></c></row>'
                   '<row r="3"><c r="A3" t="inlineStr"><is><t>FALSE</t></is></c></row>'
                   '</sheetData></worksheet>')


def test_workbook_sheet(spark, tmp_dir):
    _xlsx(os.path.join(tmp_dir, "book.xlsx"))
    df = read_sheet(spark, os.path.join(tmp_dir, "*.xlsx"), "rated_with_quotes", ["RATING", "QUOTE 1"])
    rows = sorted(df.collect(), key=lambda r: r.pos)
    assert [(r.pos, r.RATING, r["QUOTE 1"]) for r in rows] == [(0, "FAKE", "first quote"), (1, "FALSE", None)]


def test_row_positions_across_files(spark, tmp_dir):
    folder = os.path.join(tmp_dir, "parts")
    os.makedirs(folder)
    for name, rows in (("a.csv", ["x1", "x2", "x3"]), ("b.csv", ["y1"]), ("c.csv", ["z1", "z2"])):
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            f.write("text,label\n" + "".join(f"{r},L\n" for r in rows))
    df = dl.read_csv(spark, folder, ["text", "label"], with_position="pos")
    got = sorted((r.pos, r.text) for r in df.collect())
    assert got == list(enumerate(["x1", "x2", "x3", "y1", "z1", "z2"]))


def _file(folder, name, body):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(body)
    return path


def test_columns_are_taken_by_name(spark, tmp_dir):
    path = _file(tmp_dir, "f.csv", "ID,RATING,QUOTE\n1,FAKE,x\n2,TRUE,y\n")
    rows = dl.read_csv(spark, path, ["QUOTE", "RATING"]).orderBy("QUOTE").collect()
    assert [tuple(r) for r in rows] == [("x", "FAKE"), ("y", "TRUE")]
    with pytest.raises(ValueError, match="no column NOPE"):
        dl.read_csv(spark, path, ["NOPE"])


def test_files_with_other_headers_fail(spark, tmp_dir):
    folder = os.path.join(tmp_dir, "mixed")
    os.makedirs(folder)
    _file(folder, "a.csv", "x,y\n1,2\n")
    _file(folder, "b.csv", "y,x\n1,2\n")
    with pytest.raises(Exception):
        dl.read_csv(spark, folder, ["x"]).collect()


@pytest.mark.parametrize("row", ["2", "2,TRUE,y,z"])
def test_malformed_rows_fail_or_are_told(spark, tmp_dir, row):
    path = _file(tmp_dir, "bad.csv", f"ID,RATING,QUOTE\n1,FAKE,x\n{row}\n")
    with pytest.raises(Exception):
        dl.read_csv(spark, path, ["QUOTE"]).collect()
    assert dl.read_csv(spark, path, ["ID"], malformed="drop").count() == 1
    kept = dl.read_csv(spark, path, ["ID"], malformed="keep")
    assert sorted(r[dl.MALFORMED] or "" for r in kept.collect()) == ["", row]


def test_workbook_without_the_column_fails(spark, tmp_dir):
    _xlsx(os.path.join(tmp_dir, "book.xlsx"))
    with pytest.raises(Exception, match="no column"):
        read_sheet(spark, os.path.join(tmp_dir, "*.xlsx"), "rated_with_quotes", ["QUOTE 9"]).collect()
