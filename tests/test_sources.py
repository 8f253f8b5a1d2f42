from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skein.functions import predicates as P
from skein.functions import text as X
from skein.operators import joins, labels
from skein.sources import readers, sinks


def put(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    return str(folder)


def one(spark, c, **values):
    df = spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["_"])
    return df.select(c.alias("x")).first().x


def test_call_lines_and_cleanup(spark, tmp_path):
    at = put(tmp_path / "g", "app1.txt", "<a.B: void m(int)> ==> ['<c.D: int n()>\\n', '<e.F: x y(z)>\\n']\nnoise\n<'q.R: a b()> ==> []\n")
    got = readers.parse_call_line(readers.call_lines(spark, at)).orderBy("line_no").collect()
    assert [(r.app, r.caller, r.callees) for r in got] == [("app1", "<a.B: void m(int)>", ["<c.D: int n()>", "<e.F: x y(z)>"]), ("app1", "<'q.R: a b()>", [])]
    tokens = one(spark, X.call_tokens(F.col("v")), v="<a.B: void m(int)> ==> ['<c.D: int n()>\\n', '<e.F: x y(z)>\\n']")
    assert [t.split(":")[0] for t in tokens] == ["<a.B", "<c.D", "<e.F"]
    dump = spark.createDataFrame([("x in <a> ==> <b>",), ("<c> ==> <d> ==> <e>",), ("none",)], "value string")
    assert [(r.caller, r.callee) for r in readers.parse_edge_dump(dump).collect()] == [("<a>", "<b>"), ("<c> ==> <d>", "<e>")]


def test_markov_golden(spark):
    from skein.operators import markov

    rows = [("a", 0, 0, "android"), ("a", 0, 1, "java"), ("a", 0, 2, "zzz"), ("a", 1, 0, "zzz"), ("a", 1, 1, "java"), ("a", 1, 2, "android"), ("a", 2, 0, "android"), ("a", 2, 1, "android")]
    t = spark.createDataFrame(rows, "app string, line_no int, pos int, state string")
    counts = markov.transition_counts(markov.caller_pairs(t, ["app"], "line_no", "pos", "state", ["android", "java"]), ["app"])
    p = {(r.src, r.dst): r.p for r in markov.transition_probabilities(counts, ["app"]).collect()}
    assert p == {("android", "java"): 0.5, ("android", "android"): 0.5, ("java", "android"): 1.0}


def test_small_formats(spark, tmp_path):
    rows = readers.lines(spark, put(tmp_path / "f", "m.txt", "AAA\tFam1\nbad line here\naaa fam2\n"))
    assert [r.value2 for r in readers.two_token_map(rows, ("key", "value2"), keep="last").collect()] == ["fam2"]
    assert readers.two_token_map(rows, ("key", "value2")).count() == 2
    rows = readers.lines(spark, put(tmp_path / "s", "m.txt", "k 2015-01-02 10:00:00\nx y\n"))
    assert [(r.key, r.first_seen) for r in readers.first_seen(rows).collect()] == [("k", "2015-01-02")]
    rows = readers.lines(spark, put(tmp_path / "c", "m.txt", "HEAD ONE\na.B\na.C\n\nHEAD TWO\nd.E\n"))
    assert [(r.category, r["class"]) for r in readers.sectioned_list(rows).orderBy("class").collect()] == [("HEAD ONE", "a.B"), ("HEAD ONE", "a.C"), ("HEAD TWO", "d.E")]
    rows = readers.lines(spark, put(tmp_path / "t", "m.txt", "<a: b c()> -> _SOURCE_\n<d: e f()> -> _SINK_\nx\n"))
    assert sorted(tuple(r) for r in readers.sources_and_sinks(rows).collect()) == [("a: b c()", "SOURCE"), ("d: e f()", "SINK")]
    rows = readers.lines(spark, put(tmp_path / "p", "m.txt", "a.b.C.run([I,java.lang.String)V  ::  P.ONE, P.TWO\n"))
    assert [tuple(r) for r in readers.permission_mapping(rows).collect()] == [("<a.b.C: V run(I[],java.lang.String)>", "P.ONE"), ("<a.b.C: V run(I[],java.lang.String)>", "P.TWO")]
    j = spark.createDataFrame([('{"P1":[["A","m"],["B","n"]],"P2":[["a","M"]]}',)], "value string")
    assert {r.api: r.permission for r in readers.inverted_json_map(j).collect()} == {"am": "P2", "bn": "P1"}
    at = put(tmp_path / "n", "app9_api.txt", "android.x,3\napk_name,1\nbad row\n")
    assert [tuple(r) for r in readers.name_counts(spark, at, "api").collect()] == [("app9", "api", "android.x", 3)]
    at = put(tmp_path / "k", "app.data", "Perm_android.permission.A_B\nUrl_x\n")
    assert sorted(tuple(r) for r in readers.key_value_tokens(spark, at).collect()) == [("app.data", "Perm", "android.permission.A_B"), ("app.data", "Url", "x")]
    rows = readers.lines(spark, put(tmp_path / "w", "n.log", "  8: 00 bl  1234 <strlen@plt>\n  9: mov r1\n"))
    assert [r.call for r in readers.native_calls(rows).collect()] == ["strlen"]
    m = readers.matrix_market(spark, put(tmp_path / "mm", "a.mtx", "%%MatrixMarket\n1 2 3.5\n2 1 -1.0\n"))
    assert sorted(tuple(r) for r in m.collect()) == [(0, 1, 3.5), (1, 0, -1.0)]


def test_logs(spark, tmp_path):
    rows = readers.lines(spark, put(tmp_path / "l", "a.log", "[main] INFO x.Y - Analyzing file one.apk\nINFO Found a flow to sink S1, from the following sources:\n- src1\n- src2\nprocessing two.apk\ntwo ran for 12.5 s\n"))
    assert sorted(tuple(r) for r in readers.flow_log(rows).collect()) == [("one.apk", "S1", "src1"), ("one.apk", "S1", "src2")]
    assert [tuple(r) for r in readers.runtime_log(rows).collect()] == [("two.apk", 12.5)]


def test_arity_is_checked(spark):
    ok = spark.createDataFrame([("a 2015 1 2",)], "value string")
    assert readers.dated_vectors(ok, 4).first().features == [1.0, 2.0]
    with pytest.raises(Exception, match="expected 5 tokens, got 4"):
        readers.dated_vectors(ok, 5).collect()


def test_manifest(spark, tmp_path):
    xml = """<manifest xmlns:android="u" package="p.q"><uses-permission android:name="android.permission.X"/><application><activity android:name=".A" android:exported="false"><intent-filter><action android:name="android.intent.action.MAIN"/><category android:name="c"/><data android:scheme="http"/></intent-filter></activity><receiver android:name="R"><intent-filter><action android:name="b.c"/></intent-filter></receiver></application></manifest>"""
    at = put(tmp_path / "x", "m.xml", xml)
    m = readers.manifests(spark, at)
    assert m.first().permissions == ["android.permission.X"] and m.first().package == "p.q"
    assert [r.action for r in readers.system_actions(m).collect()] == ["android.intent.action.MAIN"]
    f = {r.component: r for r in readers.intent_filters(readers.documents(spark, at)).collect()}
    assert f[".A"].actions == ["android.intent.action.MAIN"] and not f[".A"].exported and f[".A"].schemes == ["http"]
    assert f["R"].exported and f["R"].type == "receiver"


def test_arff_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a.apk", 0.0, 2.0, "Benign"), ("b.apk", 1.5, 0.0, "Evil")], "name string, x double, y double, class string")
    for sparse in (False, True):
        at = str(tmp_path / f"arff{sparse}")
        sinks.write_arff(df, at, "rel", {"class": ["Benign", "Evil"]}, sparse)
        assert (tmp_path / f"arff{sparse}" / "header.arff").read_text().splitlines()[-1] == "@DATA"
        back = readers.arff(spark, at)
        assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())


def test_writers(spark, tmp_path):
    t = spark.createDataFrame([("a", "K", "v"), ("a", "K", "w")], "app string, key string, value string")
    sinks.key_value_lines(t, str(tmp_path / "kv"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "kv")).collect()) == ["K_v", "K_w"]
    sinks.by_year(spark.createDataFrame([("a", "2015")], "id string, year string"), str(tmp_path / "y"), "zoo")
    assert (tmp_path / "y" / "collection=zoo" / "year=2015").exists()
    sinks.by_archive_day(spark.createDataFrame([("a", "20150102030405")], "id string, stamp string"), "stamp", str(tmp_path / "d"))
    assert (tmp_path / "d" / "day=20150102").exists()
    wide = sinks.spread(spark.createDataFrame([("a", [1.0, 2.0], 1)], "sha256 string, features array<double>, label int"), "features", ["p", "q"])
    sinks.feature_csv(wide, str(tmp_path / "csv"))
    back = readers.centrality_csv(spark, str(tmp_path / "csv")).first()
    assert (back.sha256, back.features, back.label) == ("a", [1.0, 2.0], 1)
    assert readers.wide_features(spark, str(tmp_path / "csv")).columns == ["p", "q", "label"]
    files = readers.list_files(spark, str(tmp_path / "csv"), "csv")
    assert files.count() >= 1 and readers.list_directories(files).count() == 1


def test_net_addresses(spark):
    def kind(v):
        r = one(spark, X.net_address(F.col("v")), v=v)
        return (r.kind, r.address) if r else None

    assert kind("192.168.0.1") == ("ip", "192.168.0.1")
    assert kind("a 192.168.0.1 b") == ("ip", "192.168.0.1")
    assert kind("www.google.com") == ("host", "www.google.com")
    assert kind("google.com") == ("host", "google.com")
    assert kind("hey everybody") is None and kind("true") is None
    assert kind("http://www.google.com/a/b/v.htm") == ("iri", "http://www.google.com/a/b/v.htm")
    assert kind("example.technology") == ("host", "example.technology")
    assert kind("010.001.0.1") == ("ip", "010.001.0.1") and kind("10.0.0.1.") == ("ip", "10.0.0.1")
    assert kind("market://details?id=a.b") == ("iri", "market://details?id=a.b") and kind("content://sms/inbox")[0] == "iri"
    assert kind("see http://a.com/b now") is None and kind("HTTP://A.COM") is None and kind("http://a.com/%7") is None
    assert kind("a" * 64 + ".com") is None and kind("-a.com") is None and kind("a.b") is None
    assert kind("http://[1:2:3:4:5:6:7:8]/")[0] == "iri" and kind("http://[::1]")[0] == "iri" and kind("http://[1::2:3:4:5:6]/") is None
    assert kind("x:" + "y" * 200_000)[0] == "iri" and kind("x:" + "y" * 200_000 + " ") is None


def test_api_lists_and_rules(spark):
    senders = ["removeStickyBroadcast", "removeStickyBroadcastAsUser", "stopService", "sendStickyOrderedBroadcastAsUser", "startIntentSenderForResult", "startIntentSenderFromChild"]
    assert len(P.SENDING_APIS) == 23 and all(one(spark, P.is_sending_api(F.col("v")), v=x) for x in senders)
    assert not one(spark, P.is_sending_api(F.col("v")), v="setResult") and P.RECEIVING_APIS == ["getIntent", "getParentActivityIntent"]
    layer = lambda c: one(spark, P.code_layer(F.col("v"), F.lit("my.app")), v=c)
    for c in ("gov.nist.A", "junit.A", "libcore.A", "net.oauth.A", "org.ccil.A", "org.javia.A", "org.jivesoftware.A", "sun.A", "com.adobe.A", "com.svox.A", "jp.co.omronsoft.A", "org.kxml2.A", "com.example.android.A"):
        assert layer(c) == "SDK"
    assert layer("com.my.app.sun.A") == "UserCode" and layer("sun") == layer("xsun.A") == "3rdLib" and layer("") == "Unknown"
    calls = lambda *v: one(spark, P.suspicious_apis(F.col("v")), v=list(v))
    assert calls("const-string v0, Cipher", "x") == [] and calls("invoke-virtual v0, Ljavax/crypto/Cipher;->doFinal()V") == []
    assert calls("invoke-static v0, Landroid/a/B;->Cipher()V", "invoke-static v0, Landroid/a/B;->Cipher()V") == ["Landroid/a/B.Cipher"]
    assert calls("invoke-virtual Ljava/io/IOException;->printStackTrace()V", "nop android/os/Exec") == ["Ljava/io/IOException;->printStackTrace", "android/os/Exec"]
    assert calls("sget Lorg/apache/http/client/methods/HttpPost;->x") == []
    assert one(spark, F.size(P.platform_apis(F.col("v"))), v=["invoke-x v0, Landroid/a/B;->c(I)V", "invoke-x v0, Lb/C;->d()V"]) == 1


def test_url_domains(spark):
    d = lambda v, literal=False: one(spark, X.url_domain(F.col("v"), literal), v=v)
    assert d("http://10.1.2.3/x") == "10.1.2.3" and d("https://site.technology/a") == "site.technology" and d("HTTP://A.b.com:80/") == "A.b.com"
    assert d("x https://a.example.com\\y") == "a.example.com" and d("none") is None and d("http://localhost/") is None
    assert d("http://10.1.2.3/x", True) == "10.1.2.3" and d("http://a.com/x", True) is None and d("http://x.y{2, 6}/z", True) == "x.y{2, 6}"


def test_scalar_functions(spark):
    assert one(spark, X.obfuscation_class(F.col("v")), v="a.b.Long") == "obfuscated"
    assert one(spark, X.obfuscation_class_strict(F.col("v")), v="a.Long") == "self-defined"
    assert one(spark, X.legacy_state(F.col("v"), ["java", "java.util"]), v="java.util.Map$Entry") == "java.util"
    assert one(spark, X.legacy_state(F.col("v"), ["java"]), v="junit.x") is None
    assert one(spark, X.percentage(F.col("a"), F.col("b")), a=1, b=0) == 0.0
    assert one(spark, X.joined_categories(F.col("v")), v=["a", "b", "c"]) == "ab;c;"
    assert one(spark, X.trace_call(F.col("v")), v="<a> -> <b>")["callee"] == "b"
    assert one(spark, X.class_of(F.col("v")), v="<a.B: int c()>") == "a.B"
    assert one(spark, X.instruction_api(F.col("v")), v="v1, Landroid/x/Y;->run(I)V")["class"] == "android.x.Y"
    assert one(spark, X.renamed(F.col("v"), {"com.a.": "A"}), v="com.a.") == "A"
    assert one(spark, X.package_walk(F.col("v"), [["a"], ["b"]], ["a.b", "a"]), v="a.b") is None
    assert one(spark, X.package_walk(F.col("v"), [["a"], ["b"]], ["a.b", "a"]), v="a.b.Cls") == "a.b"
    assert one(spark, X.url_domain(F.col("v")), v="x https://a.example.com/q") == "a.example.com"
    r = one(spark, P.used_and_restricted(F.col("a"), F.col("b")), a=["p", "q"], b=["q", "r"])
    assert (r.used, r.restricted) == (["q"], ["r"])


def test_feature_names_raise_instead_of_dropping(spark):
    from skein.operators import counts

    df = spark.range(12).selectExpr("concat('n', id) AS name")
    assert len(counts.feature_names(df, "name", 12)) == 12
    with pytest.raises(ValueError, match="more than 11"):
        counts.feature_names(df, "name", 11)


def test_short_and_long_phrases_are_found_alike(spark):
    import random

    rnd = random.Random(2)
    words = ["ab", "b", "cab", "d", "bb"]
    texts = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12)))) for i in range(60)]
    phrases = [(100 + i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 7)))[rnd.randint(0, 1) :]) for i in range(40)]
    t, p = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(phrases, "item long, phrase string")
    got = sorted((r.id, r.item) for r in joins.contains_join(t, "text", "id", p, "phrase").select("id", "item").collect())
    assert got == sorted((i, j) for i, x in texts for j, y in phrases if y in x)
    long = p.where("size(split(phrase, ' ')) > 4")
    plan = joins.contains_join(t, "text", "id", long, "phrase")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan


def test_label_rules(spark):
    d = spark.createDataFrame([("t2_ab.apk", 1), ("t1_ab.apk", 2), ("cd.apk", 3)], "name string, x int")
    assert sorted(r.name for r in labels.keep_least_transformed(d, "name").collect()) == ["cd.apk", "t1_ab.apk"]
    base = spark.createDataFrame([("ab.apk",), ("zz.apk",)], "name string")
    assert [r.name for r in joins.not_transformed(base, d, "name").collect()] == ["zz.apk"]
    a = spark.createDataFrame([(1, [1.0], 0)], "id int, features array<double>, label int")
    with pytest.raises(Exception, match="labels differ"):
        joins.zip_vectors([a, a.withColumn("label", F.lit(1))], "id").collect()
