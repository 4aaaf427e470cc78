from pyspark.sql import functions as F

from weftwork.llm import credentials as CR
from weftwork.llm import docpairs as DP
from weftwork.llm import hidden_prose as HP
from weftwork.llm import language as LG
from weftwork.llm.prose import bare, repaired
from weftwork.llm.syntax import functions, masked, spans

JAVA = '''/* This file is part of a project and may be shared. */
package a.b;

public class Box {
    // Der Wert wird nicht mehr gebraucht, sobald alle fertig sind.
    private int size = 3; // trailing

    /**
     * Counts the open boxes and waits for the last one to close.
     */
    @Override
    public <T> List<T> countBoxes(Map<String, List<T>> in, int n) throws IOException {
        if (n > 3) { run(new Runnable() { public void run() { go("} fn x() {"); } }); }
        for (int i = 0; i < n; i++) { synchronized (this) { next(); } }
        return out;
    }

    /** TODO */
    void empty() {
        // nothing
    }

    /*
    public void goneOld() { x(); }
    */

    /** Keeps the last answer until a newer one arrives. */
    Box(int a) { this.a = a; }

    abstract void none();
}
'''


def test_java_functions():
    got = {f.name: f for f in functions(JAVA, "java")}
    assert {k for k in got if k != "run"} == {"countBoxes", "empty", "Box"}
    assert "Counts the open" in got["countBoxes"].docs and got["empty"].empty and "until a newer" in got["Box"].docs
    f = got["countBoxes"]
    assert JAVA[f.start:f.stop].startswith("@Override") and JAVA[f.start:f.stop].endswith("}")


def test_other_languages():
    rs = '/// Moves the head.\n#[inline]\npub(crate) fn move_head<\'a>(x: &\'a str) -> Option<u32> { r#"fn no() {"#; Some(1) }\n/* a /* nested */ fn gone() {} */\nfn two() {}'
    got = {f.name: f for f in functions(rs, "rust")}
    assert set(got) == {"move_head", "two"} and got["move_head"].docs == "/// Moves the head." and got["two"].empty
    kt = "class A {\n    /** Doc. */\n    private fun <T> String.cut(n: Int): T {\n        return x\n    }\n}"
    assert [(f.name, f.docs) for f in functions(kt, "kotlin")] == [("cut", "/** Doc. */")]
    sw = "/// One.\n/// Two.\nfileprivate func go(a: Int) throws -> [String: Int] { return [:] }\n// apart\n\nfunc b() { x() }"
    assert [(f.name, f.docs) for f in functions(sw, "swift")] == [("go", "/// One.\n/// Two."), ("b", "")]
    zg = 'const s = struct {\n    x: u32 = 1, // of x\n    /// Walks.\n    pub fn walk(self: *Self) !void {\n        @panic("}");\n    }\n};'
    assert [(f.name, f.docs) for f in functions(zg, "zig")] == [("walk", "/// Walks.")]
    assert functions("", "java") == [] and functions("fn x(", "rust") == []
    text = 'a "b{" // }\n\'c\' /* { */'
    assert len(masked(text, spans(text, "java"))) == len(text) and "{" not in masked(text, spans(text, "java"))


def test_telling_descriptions():
    own = DP.name_words("joinTreeRange", "Box", "tree")
    for d in ("Throws if closed.", "Not thread-safe.", "/// Nicht threadsicher.", "@since 1.2\nWaits for the caller to answer.", "各レプリカは木をたどります。", "Never returns null.\n@param x y"):
        assert DP.says_something(d, own), d
    for d in (None, "", " ", "///", "/** */", "Join tree range.", "Joins the range of this box for the specified tree.", "@param tree the tree\n@return the range", "TODO", "TODO(me): describe this", "FIXME: add a description later.",
              "Generated by a tool. Changes to this block will be overwritten.", "Copyright 2026 the authors. All rights reserved.", "{@inheritDoc}\n@see Box#join", "int a = b(3);\nreturn a;", "joinTreeRange(tree)", "no description", "説明なし",
              "Noch keine Beschreibung.", "=====", "N/A", "This is the function joinTreeRange of this class."):
        assert not DP.says_something(d, own), d


def test_pairs(spark):
    rows = [(1, "java", None, "a", "O", None, None, "Waits for the last answer.", "void a() { x(); }"), (2, "java", None, "b", "O", None, None, None, "/** Keeps the newest head only. */\nvoid b() { x(); }"),
            (3, "rust", None, "c", None, [("p", "T"), None], "T", "TODO", "fn c() { x }"), (4, "java", None, "d", None, None, None, "Waits for an answer.", "// void d() { x(); }"), (5, "zig", None, "e", None, None, None, "Waits for an answer.", None),
            (6, None, "x.kt", None, None, None, None, "Waits for an answer.", "fun f() { y() }"), (7, "java", None, "g", None, None, None, "Waits for an answer.", "void g() { }")]
    df = spark.createDataFrame([(*r, "clash") for r in rows + rows[:1]], "function_id int, language string, file_path string, function_name string, owner_name string, params array<struct<name: string, type: string>>, return_type string, doc string, body_source string, code string")
    got = {(r.record_id, r.function_name) for r in DP.pairs_of_functions(df).collect()}
    assert got == {(1, "a"), (2, "b"), (6, "f")}
    files = spark.createDataFrame([(1, None, "a/Box.java", JAVA), (2, None, None, None), (3, "java", None, "")], "file_id int, language string, file_path string, content string")
    assert {(r.record_id, r.function_name) for r in DP.pairs_of_files(files).collect()} == {(1, "countBoxes"), (1, "Box")}
    assert DP.pairs_of_files(files.limit(0)).count() == 0


AWS = "AKIA" + "Q7GGXZHRAL3XL2RM"


def test_credentials(spark):
    pem = "-----BEGIN EC " + "PRIVATE KEY-----"
    b64 = "KVmXv2nM4zJ8K/xRh5L/HzXsRNOlt7HGVGq6cVL38tx7YCG9EwTd9phr1uMF+9E1"
    rows = [(1, f'x = 1;\nclient.use("{AWS}");', None), (2, 'String password = "Tree#4913*river";\nString pwd = "changeme";', None), (3, 'open("amqp://a_b:pdaaHOcLS6Q@host.example:1/x");\nopen("amqp://" + user + ":" + token + "@x");', None),
            (4, f'k = "{pem}\\n"\n  + "{b64}\\n"\n  + "-----END EC PRIVATE KEY-----";\nint z;', None), (5, f'String apiKey = "{AWS}"; // {CR.ALLOW}', None), (6, "'Moss#1234?river'", "smtpPassword"), (7, "'orders_2'", "accessTokenTable"),
            (8, None, None), (9, "", None), (10, "commit 026514b334f47b6fbb145862b720e83864ed1af2\nString id = \"45d93c80-d0f7-45da-a9da-29ddabfeddc7\";", None), (11, "var secretKey = vault.read(\"a/secretKey\");\nString t = System.getenv(\"AUTH_TOKEN\");", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "i int, t string, c string, line_no int")
    got = {(r.record_id, r.line_no) for r in CR.credential_places(df, F.col("i"), F.col("t"), F.col("c")).filter("begins").collect()}
    assert got == {(1, 2), (2, 1), (3, 1), (4, 1), (6, 1)}
    red = {r.record_id: r.text for r in CR.without_credentials(df, F.col("i"), F.col("t"), F.col("c")).collect()}
    for i, t, _ in rows:
        assert red[i] is None if t is None else len(red[i]) == len(t) and red[i].count("\n") == t.count("\n") and red[i].count('"') == t.count('"')
    assert AWS not in red[1] and red[1].startswith("x = 1;\nclient.use(\"") and b64 not in red[4] and red[10] == rows[9][1] and red[5] == rows[4][1]


def test_credential_model_on_held_out_lines():
    ex = CR.examples(800, seed=77)
    right = 0
    for e in ex:
        slots, y = CR.labelled(e)
        right += max(y, default=0) == max(CR.fitted().viterbi(slots), default=0)
    assert right >= 780


def test_gate_passes_every_line_with_a_sign():
    lost = [(line, ctx) for seed in (11, 77) for line, ctx, pem, spans in CR.examples(6_000, seed) if spans and not pem and not CR._worth(line, ctx)]
    assert not lost
    values = ["0f" * 16, "Maple#4821!garden", "abc$123XY", "aB3" * 9, "aB3+" * 7 + "==", AWS, "sk_live_" + "aB3" * 8, "eyJ" + "aB3" * 10 + ".eyJ" + "aB3" * 12 + "." + "xY7" * 14]
    for k in CR._KEYS:
        for name in (k, k.upper(), k.replace("_", "-"), "order" + k[:1].upper() + k[1:], "order_" + k):
            for v in values:
                assert CR._worth(f"x;\n{name} = '{v}'", None) == {3} and CR._worth(v, name), (name, v)


def test_private_keys_are_found_and_redacted():
    for line, v in (('privateKey = "{}"', "0123456789abcdef" * 2), ("private_key: '{}'", "Maple#4821!garden"), ("PRIVATE_KEY={}", "Maple#4821!garden")):
        text = "x = 1\n" + line.format(v)
        found = CR.scan(text, None, CR.fitted())
        assert [(f.line_no, text[f.start:f.stop]) for f in found] == [(2, v)] and v not in CR.redacted(text, found)


def test_viterbi_of_mixed_text():
    a, b = "The reader waits until all of the changes have been written. ", "int pos = cell.size() - 36; map.put(\"a1{\", x.y(3));"
    p = LG.viterbi([a + b, "", "Die Prüfung wartet, bis alle Änderungen geschrieben sind."])
    assert (p[0][:len(a) - 3] == LG.STATES.index("en")).mean() > 0.9 and (p[0][-30:] == 0).all() and len(p[1]) == 0 and (p[2] == LG.STATES.index("de")).mean() > 0.9


def test_language_of_seeds_held_out():
    for lang, t in {"fr": "Le contrôle garde la réponse tant que personne ne la demande.", "es": "El programa guarda la respuesta mientras nadie la pide.", "it": "Il programma conserva la risposta finché nessuno la chiede.", "pt": "O programa guarda a resposta enquanto ninguém a pede.",
                    "nl": "Het programma bewaart het antwoord zolang niemand ernaar vraagt.", "pl": "Program przechowuje odpowiedź, dopóki nikt o nią nie prosi.", "ru": "Программа хранит ответ, пока никто его не просит.", "ja": "誰も求めないかぎり、答えを保存します。", "zh": "没有人请求时，程序会保存回答。"}.items():
        assert set(HP._phrases(t, LG.viterbi([t])[0])) == {lang}, lang


def test_hidden_prose(spark):
    docs = [(1, "/** The reader waits for the slowest answer. */"), (2, "TODO lease"), (3, None), (4, " "), (5, "@see Box\n@since 1.2"), (6, "3f786850e387550fdab836ed7e6dc881de23001b"), (7, "SELECT a_id, b_id FROM a_b WHERE a_id > 12"),
            (8, "Die Funktion wartet auf die n\\u00e4chste Antwort.\n\nThe reader waits for {@link Box} the slowest answer."), (9, "int a = b.size() - 3;\nreturn a;"), (10, "LA FONCTION ATTEND QUE TOUT SOIT ÉCRIT."), (11, "x" * 50_000)]
    df = spark.createDataFrame([(*d, "z") for d in docs], "i int, t string, nat_lang string")
    got = {(r.record_id, r.nat_lang) for r in HP.prose_of_docs(df, F.col("i"), F.col("t")).collect()}
    assert got == {(1, "en"), (8, "de"), (8, "en"), (10, "fr")}
    files = spark.createDataFrame([(1, "java", None, JAVA), (2, "java", None, 'class A { void f() { log("wait for it"); } }'), (3, None, None, None)], "i int, l string, p string, t string")
    got = {(r.record_id, r.nat_lang): r for r in HP.prose_of_files(files, F.col("i"), F.col("l"), F.col("p"), F.col("t")).collect()}
    assert set(got) == {(1, "en"), (1, "de")} and 0 < got[1, "de"].share < 0.3
    assert HP.prose_of_docs(df.limit(0), F.col("i"), F.col("t")).count() == 0


def test_prose_next_to_cjk_characters():
    for text, want in (("The reader waits until all of the changes called 変更 have been written to the disk before it closes.", {"en"}), ("Der Leser wartet, bis alle Änderungen namens 変更 auf die Platte geschrieben sind, und schließt dann.", {"de"}),
                       ("The reader waits until all of the changes have been written\nすべての変更が書き込まれるまで待ちます。", {"en", "ja"}), ("この関数は HTTP リクエスト を JSON に変換してから返します。", {"ja"}), ("変更写入之后 reader 会关闭 the file 并返回。", {"zh"})):
        assert set(HP._phrases(text, LG.viterbi([text])[0])) == want


def test_repair():
    assert repaired("La comparaison Ã©crit") == "La comparaison écrit" and repaired("\\u00e9t\\u00e9") == "été" and repaired("naïve é»") == "naïve é»"
    assert bare("/**\n * A.\n * B.\n */") == "A.\nB."


def test_headers_of_any_length():
    from weftwork.llm.syntax import functions

    many = ", ".join(f"@Named(\"n{i}\") final Map<String, List<Integer>> parameterNumber{i}" for i in range(500))
    for params in ("int a", many, many * 8):
        src = f"class A {{\n  /** Keeps the ledger in step with the outside world. */\n  public int join({params}) throws IOException, java.lang.Error {{ return 1; }}\n}}"
        got = functions(src, "java")
        assert [f.name for f in got] == ["join"] and "in step" in got[0].docs
    kt = "/** Keeps order. */ fun <T : Comparable<T>> List<T>.arrange(" + ", ".join(f"p{i}: Map<String, Int>" for i in range(3000)) + "): Int { return 1 }"
    assert [f.name for f in functions(kt, "kotlin")] == ["arrange"]
