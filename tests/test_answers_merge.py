"""Answers, prompts, merge and reports: written-out expectations."""

import json

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import answers as an
from scriptorium.functions import fixed
from scriptorium.functions import prompts as pr
from scriptorium.operators import merge as mg
from scriptorium.operators import report as rp
from scriptorium.operators import responses as rs

J = '{"nombre":"P","resumen":"R","exito":true,"performance":0.5,"extra":["a","b"]}'
T = "```"

# content -> (branch, nombre, keys)
ALL = "nombre,resumen,exito,performance,extra"
FALLBACK = ("fallback", "doc.pdf", "nombre,resumen,resultados,exito,performance")
ERROR = ("error", "doc.pdf", "nombre,error,resumen,resultados,exito,performance")
ANSWERS = {
    T + "json\n" + J + "\n" + T: ("parsed", "P", ALL),
    J: ("parsed", "P", ALL),
    T + "\n" + J + "\n" + T: ("parsed", "P", ALL),
    "x " + T + "json" + J + T + " y " + T + "json {} " + T: ("parsed", "P", ALL),
    T + "json\n" + J: ("parsed", "P", ALL),
    " plain prose ": FALLBACK,
    T + "python\n" + J + T: FALLBACK,
    J + " trailing": FALLBACK,
    "0]": FALLBACK, "1,2]x": FALLBACK, "[1] ]": FALLBACK, '{"a":1}}': FALLBACK, "": FALLBACK,
    '{"nombre":"","resumen":"r","exito":false}': ("parsed", "doc.pdf", "nombre,resumen,exito"),
    "{}": ("parsed", "doc.pdf", "nombre"),
    '{"nombre":0}': ("parsed", "doc.pdf", "nombre"),
    '{"nombre":[]}': ("parsed", "doc.pdf", "nombre"),
    '{"nombre":null,"a":1}': ("parsed", "doc.pdf", "nombre,a"),
    '{"a":1,"nombre":false}': ("parsed", "doc.pdf", "a,nombre"),
    '{"a":1}': ("parsed", "doc.pdf", "a,nombre"),
    '{"nombre":["x"]}': ("parsed", '["x"]', "nombre"),
    "[1,2]": ERROR, "null": ERROR, '"text"': ERROR, "1": ERROR, '"has nombre inside"': ERROR, None: ERROR,
}


def _parse(spark, contents):
    df = spark.createDataFrame([(i, c, "doc.pdf") for i, c in enumerate(contents)],
                               "i int, content string, paper_name string")
    return rs.analysis_columns(rs.parse_response(df)).orderBy("i").collect()


def test_parse_table(spark):
    for r, (content, want) in zip(_parse(spark, ANSWERS), ANSWERS.items()):
        assert (r.branch, r.nombre, r.keys) == want, content
        if r.branch == "fallback":
            assert r.resumen == content.strip()


REPEATED = [
    '{"a":1,"a":2}', '{"a":1,"b":{"x":[1,{"y":1,"y":[2,{"y":3}]}],"x":0},"a":{"a":1,"a":{}}}',
    '{"nombre":"P","v":NaN,"w":[Infinity,-Infinity,{"z":NaN,"z":1}]}', '{"b":1,"a":2,"b":{"c":"x, y: {\\"c\\"","c":[]}}',
    '{"a":1,"\\u0061":2,"nombre":"","nombre":"Q"}', '[{"a":1,"a":2}]', '{"a":[{"k":1},{"k":2}],"b":{"k":3},"a":{"k":4},"k":5}',
    '{"a#3":1,"a":2,"a":3,"a#3":4}', ' {"":1, "":2}\n', '{"a":{"a":{"a":{}}},"a":{"a":{"a":{"b":1,"b":2}}}}',
    '{"a":"NaN","a":NaN}', 'NaN', '[NaN]', '-Infinity']
NOT_JSON = ['{"a":1,"a":2,}', '{"a":1 "a":2}', '{"a":1,"a":2} x', '{"a":bad,"a":1}', '{"a":1,"a":}', '{"a":1 2,"a":3}',
            '{"a":+NaN}', '{"a":nan}', '{"\\q":1,"a":1,"a":2}', '{"a":1,"a":2', '[1}', '{"a":1,"a":2]', '{"a":"x,"a":1}',
            '{"a":1,#"a":2}', '{NaN:1}', '{a:1,a:2}']


def test_repeated_keys_and_constants_like_the_original(spark):
    """Every accepted text gives what Python's parser makes of it (constants as
    strings of their name); what that parser rejects stays a fallback."""
    for content, r in zip(REPEATED, _parse(spark, REPEATED)):
        want = json.loads(content, parse_constant=str)
        if not isinstance(want, dict):
            kind = "list" if isinstance(want, list) else "float"
            assert r.branch == "error" and kind in r.error or r.error == fixed.ERROR_PREFIX + fixed.ERROR_LIST, content
            continue
        want = want if want.get("nombre") else {**want, "nombre": "doc.pdf"}
        got = {k: json.loads(v.toJson()) for k, v in r.analysis.items()}
        assert r.branch == "parsed" and got == want and r["keys"] == ",".join(want), content
    for content, r in zip(NOT_JSON, _parse(spark, NOT_JSON)):
        with pytest.raises(ValueError):
            json.loads(content)
        assert r.branch == "fallback", content


def test_a_long_answer_with_repeated_keys(spark):
    content = "{" + ",".join(f'"k{i % 3000}":{{"v":{i},"v":[{i}]}}' for i in range(6000)) + "}"
    r = _parse(spark, [content])[0]
    want = {**json.loads(content), "nombre": "doc.pdf"}
    assert {k: json.loads(v.toJson()) for k, v in r.analysis.items()} == want and r["keys"] == ",".join(want)


@pytest.mark.parametrize("content,message", [
    (None, fixed.ERROR_NONE_CONTENT), ("[1]", fixed.ERROR_LIST), ('"abc"', fixed.ERROR_STR_ASSIGN),
    ('"xnombre"', fixed.ERROR_STR_INDEX), ("1", fixed.ERROR_NOT_ITERABLE.format("int")),
    ("1.5", fixed.ERROR_NOT_ITERABLE.format("float")), ("true", fixed.ERROR_NOT_ITERABLE.format("bool")),
    ("null", fixed.ERROR_NOT_ITERABLE.format("NoneType"))])
def test_error_messages(spark, content, message):
    assert [r.error for r in _parse(spark, [content])] == [fixed.ERROR_PREFIX + message]


def test_fenced_json_table(spark):
    rows = {"no fence": "no fence", f"{T}json a {T}": "a", f"x{T}json\n{{}}\n{T} y": "{}", f"{T} b {T} c": "b",
            f"{T}json a": "a", f"{T}": "", f"{T}json a{T}json b {T}": "a", f"p {T}q{T}json r {T}": "r",
            f"{T}`json a": "a", f"{T}json\xa0a\xa0{T}": "a", "``": "``"}
    df = spark.createDataFrame(list(enumerate(rows)), "i int, c string")
    got = [r[0] for r in df.orderBy("i").select(an.fenced_json("c")).collect()]
    assert got == list(rows.values())


def test_truncate_table(spark):
    rows = {"x" * 50: "x" * 50, "x" * 51: "x" * 50,
            "a-----b" + "y" * 60: ("a-----b" + "y" * 60)[:50],
            "h-----" + "b" * 80 + "-----t": "h-----" + "b" * 38 + "... [texto truncado]-----t",
            "h-----" + "b" * 80 + "-----t-----four-----five": "h-----" + "b" * 38 + "... [texto truncado]-----t",
            # heads that leave a negative budget drop that many characters from the end of the body
            "H" * 30 + "-----" + "b" * 40 + "-----" + "T" * 30:
                "H" * 30 + "-----" + "b" * 20 + "... [texto truncado]-----" + "T" * 30}
    df = spark.createDataFrame(list(enumerate(rows)), "i int, p string")
    got = [r[0] for r in df.orderBy("i").select(pr.truncate_prompt("p", 50)).collect()]
    assert got == list(rows.values())


def test_prompts_keep_slots_and_keys(spark):
    df = spark.createDataFrame([("BODY", "other")], "t string, s string")
    one = df.select(pr.analysis_prompt("t"), pr.section_prompt("t", "s"), pr.comparison_prompt("t", "s"),
                    pr.chunk_prompt("t", F.lit("LABEL"), F.lit("final"))).collect()[0]
    analysis, section, comparison, chunk = one
    assert analysis.split("-----")[1] == "\nBODY\n" and len(analysis.split("-----")) == 3
    assert all(k in analysis for k in ("nombre", "resumen", "resultados", "exito", "performance"))
    assert "other" in section.split("-----")[0] and section.split("-----")[1] == "\nBODY\n"
    assert [comparison.split("-----")[k] for k in (1, 3)] == ["\nBODY\n", "\nother\n"]
    assert "LABEL" in chunk and all(k in chunk for k in ("conclusiones", "limitaciones", "trabajo_futuro"))


def test_merge_table(spark):
    # position, is a string, value
    groups = {1: [(0, True, "a")], 2: [(0, True, "a"), (1, True, "b")], 3: [(0, True, "a"), (1, False, None)],
              4: [(0, False, None), (1, True, "b")], 5: [(0, False, "7"), (1, True, "x"), (2, True, "y")],
              6: [(0, False, "1"), (1, False, "2")], 7: [(5000, True, "late"), (3, True, "early"), (4, False, "n")]}
    want = {1: ("a", True), 2: ("a\n\nb", True), 3: (None, False), 4: ("b", True), 5: ("x\n\ny", True),
            6: ("2", False), 7: ("late", True)}
    rows = [(g, "k", *item) for g, items in groups.items() for item in items]
    df = spark.createDataFrame(rows, "conv_id bigint, k string, seq bigint, is_str boolean, v string")
    for width in (1024, 2):
        got = {r.conv_id: (r.merged, r.merged_is_str) for r in mg.merge_results(df, bucket_width=width).collect()}
        assert got == want


def _analyses(spark, items):
    df = spark.createDataFrame(list(enumerate(items)), "i int, js string")
    return df.withColumn("analysis", F.from_json("js", "map<string,variant>"))


def test_python_rendering_of_values(spark):
    values = [["a", "b"], {"k": [1, None, True, False, 0.5]}, [], {}, ["it's", 'say "x"', "both ' and \""],
              ["line\nbreak\tand \\ slash"], "plain", None, True, 3, [["n"], {"a": {"b": "c"}}]]
    df = _analyses(spark, [json.dumps({"v": v}) for v in values])
    got = [r[0] for r in df.orderBy("i").select(an.py_str(an.field(F.col("analysis"), "v"))).collect()]
    assert got == [str(v) for v in values]


def test_report_and_block(spark):
    items = ['{"nombre":"N","resumen":"S","resultados":["r1","r2"],"exito":true,"performance":null}', "{}",
             '{"exito":false,"k":"v","resumen":""}', '{"exito":null}', '{"exito":"false","l":[1]}']
    rows = rp.human_report(_analyses(spark, items)).withColumn(
        "block", mg.consolidation_block("i", "analysis")).orderBy("i").collect()
    rule = "=" * 54
    assert rows[0].report == (f"\nANÁLISIS DEL PAPER: N\n{rule}\n\nRESUMEN:\nS\n\nPRINCIPALES RESULTADOS:\n['r1', 'r2']"
                              "\n\nÉXITO DEL PAPER: Sí\n\nMÉTRICAS DE RENDIMIENTO:\nNone\n")
    assert rows[1].report == (f"\nANÁLISIS DEL PAPER: Paper sin título\n{rule}\n\nRESUMEN:\nNo hay resumen disponible"
                              "\n\nPRINCIPALES RESULTADOS:\nNo hay resultados disponibles\n\nÉXITO DEL PAPER: "
                              "No determinado\n\nMÉTRICAS DE RENDIMIENTO:\nNo especificado\n")
    labels = [r.report.split("ÉXITO DEL PAPER: ")[1].split("\n")[0] for r in rows]
    assert labels == ["Sí", "No determinado", "No", "No determinado", "Sí"]
    assert rows[0].block == "\nPARTE 1:\nResumen: S\nResultados: ['r1', 'r2']\n"
    assert rows[1].block == "\nPARTE 2:\nResumen: No disponible\nResultados: No disponible\n"
    assert rows[2].block == "\nPARTE 3:\nResumen: \nResultados: No disponible\nk: v\n"
    assert rows[4].block == "\nPARTE 5:\nResumen: No disponible\nResultados: No disponible\nl: [1]\n"


def test_structure_text_table(spark):
    cols = "i int, title string, authors string, arxiv_id string, section string, chunk_part string, total_chunks int"
    rows = {(0, "", "", "", None, None, None): "body",
            (1, "T", "", "", None, None, None): "Título: T\n\n\nbody",
            (2, "T", "A", "x1", "abstract", "2", 3):
                "Título: T\nAutores: A\nArXiv ID: x1\nSección: abstract\nParte: 2\nTotal de partes: 3\n\n\nbody",
            (3, "", "", "", "", None, 4): "Sección: \nTotal de partes: 4\n\n\nbody"}
    df = spark.createDataFrame(list(rows), cols).withColumn("text", F.lit("body"))
    got = [r[0] for r in df.orderBy("i").select(pr.structure_text(
        "text", "title", "authors", "arxiv_id", "section", "chunk_part", "total_chunks")).collect()]
    assert got == list(rows.values())


def test_summary_listing_table(spark):
    schema = "status string, nombre string, error string"

    def text(runs):
        lines = rp.summary_listing(spark.createDataFrame(runs, schema)).collect()
        return [r.line for r in sorted(lines, key=lambda r: (r.block, r.sort_key or "", r.n))]

    assert text([]) == ["No se procesaron archivos."]
    head = ["Procesamiento completado.", "Total procesados: 3", "Exitosos: 2", "Con errores: 1", "",
            "Papers procesados exitosamente:", "- Desconocido", "- b"]
    assert text([("success", "b", None), ("error", "c", None), ("success", None, None)]) == \
        head + ["", "Papers con errores:", "- c: Error desconocido"]
    assert text([("error", "a", "boom")]) == [
        "Procesamiento completado.", "Total procesados: 1", "Exitosos: 0", "Con errores: 1", "", "",
        "Papers con errores:", "- a: boom"]


def test_first_success(spark):
    rows = [(1, 1, False, "e1"), (1, 2, True, "ok2"), (1, 3, True, "ok3"), (2, 1, False, "e1"),
            (2, 2, False, "e2"), (2, 3, False, "e3"), (2, 4, True, "late")]
    df = spark.createDataFrame(rows, "request_id bigint, attempt int, ok boolean, content string")
    got = {r.request_id: (r.attempt, r.ok, r.content) for r in rs.first_success(df).collect()}
    assert got == {1: (2, True, "ok2"), 2: (3, False, "e3")}


def test_latest_by_key_breaks_ties(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", 5, "w")], "k string, s int, v string")
    assert {r.k: r.v for r in mg.latest_by_key(df, "k", "s", "v").collect()} == {"a": "z", "b": "w"}
