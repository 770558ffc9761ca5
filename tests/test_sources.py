"""Readers, writers and streams on small files."""

import json

from pyspark.sql import functions as F

from quillspark.sources import readers, writers
from quillspark.streaming import activity


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_chats(spark, tmp_path):
    j = write(tmp_path / "c.json", json.dumps([{"genid": "1", "ref": "0", "time": "10.0", "nickname": "a", "text": "x"}, {"genid": "2", "ref": "", "time": "20", "nickname": "b", "text": "y"}]))
    assert [(r.id, r.parent_id, r.user, r.ts.second) for r in readers.chat_json(spark, j).orderBy("id").collect()] == [(1, 0, "a", 10), (2, -1, "b", 20)]
    c = write(tmp_path / "c.csv", 'id,parent_id,user,text,time\n1,,a,"x, y",2020-01-02 03:04:05\n2,1,b,z,77\n')
    assert [(r.parent_id, r.text, r.ts.year) for r in readers.chat_csv(spark, c).orderBy("id").collect()] == [(-1, "x, y", 2020), (1, "z", 1970)]
    large = write(tmp_path / "l.csv", "id,p,u,d,_,_,t\n1,,a,02/01/2020 03.04.05.1,q,r,hello\n")
    assert [(r.parent_id, r.ts.month, r.text) for r in readers.chat_csv_large(spark, large).collect()] == [(-1, 1, "hello")]
    x = write(tmp_path / "c.xml", '<corpus><Dialog team="1"><Body><Turn nickname="a"><Utterance genid="1" ref="0" time="2020-01-01 00:00:00">hi</Utterance><Utterance genid="2" ref="1" time="?"> </Utterance></Turn><Turn nickname="b"><Utterance genid="3" ref="1" time="x">yo</Utterance></Turn></Body></Dialog></corpus>')
    assert [(r.id, r.parent_id, r.user, r.text) for r in readers.chat_xml(spark, x).orderBy("id").collect()] == [(0, -1, "a", "hi"), (2, 0, "b", "yo")]


def test_texts(spark, tmp_path):
    d = tmp_path / "t"
    d.mkdir()
    write(d / "a.txt", "one\ntwo\n\nthree")
    write(d / "b.txt", "four")
    write(d / "c.md", "no")
    assert {r.name: r.text for r in readers.texts(spark, str(d)).collect()} == {"a.txt": "one\ntwo\n\nthree", "b.txt": "four"}
    assert readers.texts_by_blank_line(spark, str(d)).count() == 3
    labels = write(tmp_path / "y.csv", "filename,grade\na.txt,7\nz.txt,1\n")
    assert [(r.name, r.grade) for r in readers.labelled_texts(spark, str(d), labels).collect()] == [("a.txt", "7")]


def test_lexicons(spark, tmp_path):
    r = write(tmp_path / "aoa.csv", "Word,Bird,Shock\n,m,m\nargue,,4.24\nbee,2.5,3\n")
    assert {(x.word, x.measure, x.value) for x in readers.ratings(spark, r, ["bird", "shock"]).collect()} == {("argue", "shock", 4.24), ("bee", "bird", 2.5), ("bee", "shock", 3.0)}
    v = write(tmp_path / "v.csv", "word;pos;neg\ngood;1;0\nbad;0;2\nnil;;0\n")
    assert {(x.list, x.word) for x in readers.valence(spark, v).collect()} == {("pos", "good"), ("neg", "bad")}
    p = write(tmp_path / "p.txt", "FIRST person\nI\nwe\n\nsecond person\nyou\n")
    assert sorted((x.kind, x.word) for x in readers.sectioned_words(spark, p, {"first": "fst", "second": "snd"}).collect()) == [("fst", "i"), ("fst", "we"), ("snd", "you")]
    w = write(tmp_path / "w.txt", "2 3\ncat 1 0 0.5\ndog 0 1 -2\n")
    assert {x.word: x.vec for x in readers.word_vectors(spark, w).collect()} == {"cat": [1, 0, 0.5], "dog": [0, 1, -2]}
    s = write(tmp_path / "s.txt", "HELLO HH AH-L OW\nA AH\n")
    d = readers.syllables(spark, s)
    assert {x.word: x.syllables for x in d.collect()} == {"HELLO": [["HH", "AH"], ["L", "OW"]], "A": [["AH"]]}
    assert readers.merged_syllables(d, d).count() == 2


def test_other_formats(spark, tmp_path):
    c = write(tmp_path / "x.conllu", "# id\n1\tOmul\tom\tNOUN\tNc\tCase=Acc,Nom|Number=Sing\t2\tnsubj\t_\t_\n2\tvine\tveni\tVERB\tV\t_\t0\troot\t_\t_\n\n# id\n1\tDa\tda\tADV\tR\t_\t0\troot\t_\t_\n")
    rows = readers.conllu(spark, c).orderBy("sentence", "ix").collect()
    assert [(r.form, r.head) for r in rows] == [("Omul", 2), ("vine", 0), ("Da", 0)] and rows[0].feats == {"Case": "Acc,Nom", "Number": "Sing"}
    j = write(tmp_path / "r.jsonl", "\n".join(json.dumps({"_source": {"Review": {"ReviewBody": "b", "ReviewRating": n}, "Product": {"ProductCategory": "c"}}}) for n in (0, 5)))
    assert readers.reviews(spark, j).count() == 1 and readers.reviews(spark, j, False).count() == 2
    a = write(tmp_path / "a.xml", "<as><article><title>T</title><abstract>A</abstract><authors>X, Y;Z</authors><year>2001</year></article><article><title>U</title></article></as>")
    assert [(r.title, r.authors, r.date.year) for r in readers.articles_xml(spark, a).collect()] == [("T", ["X", "Y", "Z"], 2001)]
    g = write(tmp_path / "g.txt", "right\nwrong\ngood\n")
    assert [(r.line_no, r.text) for r in readers.correction_lines(spark, g).collect()] == [(0, "right"), (1, "wrong"), (2, "good")]
    d = spark.createDataFrame([(t,) for t in ("2020-01-02 03:04:05", "02/01/2020 03:04:05.25", "2021-03-04 05:06 UTC", "nonsense", None)], "t string")
    assert [None if r[0] is None else r[0].year for r in d.select(readers.date(F.col("t"))).collect()] == [2020, 2020, 2021, None, None]
    p = spark.createDataFrame([(0, 1.0, 0.0), (1, 3.0, 0.0)], "o int, x double, z double")
    assert [(r.label, r.x, r.z) for r in readers.paired_features(p, "o", ["x", "z"]).orderBy("label").collect()] == [(0, 25.0, 0.0), (1, 75.0, 0.0)]


def test_writers(spark, tmp_path):
    f = spark.createDataFrame([(1, "M(Wd / Sent)", 2.0), (2, "M(Wd / Sent)", 3.0)], "doc_id int, index string, value double")
    writers.features_csv(f, ["M(Wd / Sent)", "M(Sent / Doc)"], str(tmp_path / "f"))
    back = readers.feature_table(spark, str(tmp_path / "f"))
    assert back.columns == ["doc_id", "M(Wd / Sent)", "M(Sent / Doc)"] and back.count() == 2
    writers.dataset(f, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 2
    writers.json_lines(f, str(tmp_path / "j"))
    writers.participants_csv(f.withColumnRenamed("doc_id", "participant"), ["M(Wd / Sent)"], str(tmp_path / "p"))


def test_streams(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = activity.events(spark, str(tmp_path / "in"))
    w = activity.once(activity.windowed(stream, late="60 days"), "w", str(tmp_path / "cw"), "complete")
    assert w.agg(F.sum("posts")).first()[0] == 1000
    assert activity.once(activity.sessions(stream), "s", str(tmp_path / "cs")).count() >= 0
    r = activity.once(activity.runs(stream), "r", str(tmp_path / "cr"))
    assert r.filter("n < 1").count() == 0
