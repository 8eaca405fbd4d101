import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wakeline.llm import leaks as L
from wakeline.llm import pairs as P
from wakeline.llm import quality as Q

EN = "The agent read the file and then it changed the function so that the test passes. "
DE = "Der Agent hat die Datei gelesen und dann die Funktion geändert, damit der Test nicht mehr fehlschlägt. "
FR = "L'agent a lu le fichier puis il a changé la fonction pour que le test passe sans erreur. "
ES = "El agente leyó el archivo y después cambió la función para que la prueba pase sin errores. "
PT = "O agente leu o arquivo e depois mudou a função para que o teste passe sem erros. "
RU = "Агент прочитал файл и затем изменил функцию, чтобы тест проходил без ошибок. "
ZH = "代理读取了文件，然后修改了函数，使测试能够通过。"
PROSE = {"en": EN, "de": DE, "fr": FR, "es": ES, "pt": PT, "ru": RU, "zh": ZH}


@pytest.mark.parametrize("lang", list(PROSE))
def test_prose_stays_prose(lang):
    t = PROSE[lang] * 6
    for x in (t, t.lower().replace(".", ""), "\n".join(PROSE[lang] for _ in range(3)) + PROSE[lang], t + "\n- one\n- two\n\n```\na | b\n```"):
        varied = x + "".join(f" {w}" for w in PROSE[lang].split()[::-1])
        assert Q.verdict(varied) == "prose"


@pytest.mark.parametrize(
    ("text", "form"),
    [
        ("- a b\n- c d\n- e\n* f", "list"), ("1. x\n2. y z\n3. w", "list"), ("a) one\nb) two\nc) three", "list"), ("src/a.py\nsrc/b.py\nlib/c.go\nlib/d.rs", "list"),
        ("| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |", "table"), ("a\tb\tc\n1\t2\t3\n4\t\t6", "table"), ("a,b,c\n1,2,3\n4,5,6", "table"), ("a;b\n1;2\n3;4\n5;6", "table"), ("<table>\n<tr><td>a</td><td>b</td></tr>\n</table>", "table"), ("name   size   kind\nfoo    12     bar\nbaz    7      qux", "table"),
        ("", "junk"), (None, "junk"), (" \n\t ", "junk"), ("null, " * 60, "junk"), ("=- " * 80, "junk"), ("~=>]-$**>&%\\ ::@ [\\~$/}#;~=};<_|~@}@<#} ={]#@" * 4, "junk"), ("1IQyIWYMh2YAdYCbSNcJlwuRCpNwUDc+bRO9kvatKUusrGx9gZNsDcYG28hZQNPKx3PEP1TF\n" * 3 + "QcR5lE6QDyFGPJ2zjZPn6w6olpnVFGzoSFnqKabcdefgh1234567890", "junk"),
        ("00000000  5b 5f fe 85 de c0 3a aa 27 24 ff 9a fe 58 18 46\n00000010  e8 12 6a 76 34 21 cc 49 75 7a 58 7b 0f 69 00 01", "junk"), (ZH.encode().decode("latin-1") * 3, "junk"), ("mwxt ;bbp nmzgzkl wxrndpv plpkr kys]tu fwkdtn ttwl ]kth]c vkgjnj ddst;v]d zcjjgw ]qcmd;sl ;[[knrvx", "junk"),
    ],
)
def test_forms(text, form):
    assert Q.verdict(text) == form


def test_statistics(spark):
    df = spark.createDataFrame([("k", "One two, three.\nfour", 1), (None, None, 2), ("r", "x" * 200_000, 3), ("k", "One two, three.\nfour", 4)], "n_words string, text string, form int")
    rows = Q.text_statistics(df, "n_words", "text").collect()
    assert rows[0].asDict().keys() == {"n_words", "_n_words", "mean_word_length", "symbol_ratio", "line_end_share", "common_word_share", "form"}
    got = [r for r in rows if r.n_words == "k"]
    assert len(got) == 2
    assert (got[0]._n_words, got[0].mean_word_length, got[0].line_end_share) == (4, 15 / 4, 0.5)
    assert got[0].symbol_ratio == pytest.approx(2 / 17)
    assert Q.text_statistics(df.limit(0), "n_words", "text").count() == 0


def words(rnd, n):
    return [f"w{rnd.randrange(400)}" for _ in range(n)]


def best_by_brute_force(a, b, rate):
    """Longest stretch of b, from match to match, within one change in `rate` words, by edit distance over all stretches."""
    best = 0
    for j in range(len(b)):
        for i in range(len(a)):
            if a[i] != b[j]:
                continue
            row = list(range(len(a) - i + 1))
            for n in range(1, len(b) - j + 1):
                new = [n]
                for k in range(1, len(row)):
                    new.append(min(row[k] + 1, new[-1] + 1, row[k - 1] + (a[i + k - 1] != b[j + n - 1])))
                row = new
                if min(row[1:], default=99) * rate <= n and n > best:
                    best = n
    return best


def test_leaks_against_brute_force():
    rnd = random.Random(11)
    items = [(k, "p", " ".join(words(rnd, rnd.choice([18, 24, 40])))) for k in range(8)]
    index = L.build_index(items)
    for _ in range(60):
        k, _, text = rnd.choice(items)
        w = text.split()
        n = rnd.choice([12, 16, 20, 22, len(w)])
        at = rnd.randint(0, max(0, len(w) - n))
        passage = w[at : at + n]
        for _ in range(rnd.choice([0, 0, 1, 2, 4])):
            x = rnd.randrange(1, len(passage) - 1)
            passage[x : x + 1] = rnd.choice([[], ["new"], [passage[x], "new"]])
        doc = words(rnd, 15) + passage + words(rnd, 15)
        found = {i: n for _, i, _, n, _ in L.search([", ".join(doc).upper()], index)}
        for i, _, t in items:
            want = best_by_brute_force(doc, t.split(), L.RATE)
            if want >= L.MIN_WORDS + 2:
                assert found.get(i, 0) >= L.MIN_WORDS
            if want < L.MIN_WORDS:
                assert i not in found


def test_guaranteed_stretch():
    assert L.stretch(20) == 6
    for n in range(20, 120):
        assert L.stretch(n) * (n // 10 + 1) >= n - n // 10


def test_leaks_in_spark(spark):
    rnd = random.Random(12)
    w = words(rnd, 60)
    docs = [(1, "intro " + " ".join(w[5:40]), "p", 9), (2, " ".join(w[:12]), "p", 9), (3, None, "p", 9), (4, "", "p", 9), (5, "x " * 30_000 + "-".join(w[20:50]), "p", 9), (1, "intro " + " ".join(w[5:40]), "p", 9)]
    d = spark.createDataFrame(docs, "doc_id long, text string, part string, item_id int")
    i = spark.createDataFrame([(7, " ".join(w), None), (7, " ".join(w), None), (8, "too short", ""), (None, " ".join(w), "")], "item_id long, a string, b string")
    got = L.leaks(d, "doc_id", "text", i, "item_id", ["a", "b"])
    assert {(r.doc_key, r.item_key, r.part, r.n_words, r.n_changes) for r in got.collect()} == {(1, 7, "a", 35, 0), (5, 7, "a", 30, 0)}
    assert L.leaks(d, "doc_id", "text", i.limit(0), "item_id", ["a"]).count() == 0
    assert L.leaks(d.limit(0), "doc_id", "text", i, "item_id", ["a"]).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    rnd = random.Random(13)
    texts = [" ".join(words(rnd, 30)) for _ in range(4)]
    monkeypatch.setattr(L, "BLOCK_CHARS", 200)
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = L.leaks(d, "doc_id", "text", d.withColumnsRenamed({"doc_id": "item_id", "text": "a"}), "item_id", ["a"])
    assert {(r.doc_key, r.item_key) for r in got.collect()} == {(k, k) for k in range(4)}


EMPTY = [None, "", "  \n", "​", "N/A", "none", "TODO", "-", "...", "# Summary\n\n", "Summary:", "```\n```", "<summary>\n</summary>", "## A\n\n## B\n", "(empty)", "**Summary:**"]
REFUSALS = ["I cannot comply with this request.", "Sorry, I won't be able to assist here. Is there something else I can do?", "As an AI system, I must decline to describe these steps.", "> I'm unable to view the actions.", "**Summary:** This is something I cannot do.", "it would not be appropriate for me to answer.", "Lo siento, pero no puedo ayudar con esta solicitud.", "Je dois refuser, car je n'ai pas accès à cette trajectoire.", "Leider darf ich diesen Verlauf nicht zusammenfassen.", "Não me é possível resumir este conteúdo.", "К сожалению, я не могу обобщить этот журнал.", "抱歉，我无法总结这段内容。"]
FINE = ['The test expects the message "I cannot help with that" and passes now.', "A note says sorry for the stale pager, but the code is fine.", "The command was unable to fold the file and exited with code 3.", "The client refused the connection, so the agent patched it."]


@pytest.mark.parametrize("text", EMPTY)
def test_empty_summaries(text):
    assert P.is_empty(text)


def test_refusals():
    assert [t for t in REFUSALS if not P.is_refusal(t)] == []
    assert [t for t in FINE if P.is_refusal(t) or P.is_empty(t)] == []


def test_echo():
    task = "Fix the `load` error in a/b.py. It fails when the cache is empty, and nobody knows why it does."
    assert P.echo_share("Summary: IT FAILS WHEN THE CACHE IS EMPTY, and nobody knows why it does. Fix the load error in a/b.py", [task]) > 0.8
    assert P.echo_share('"Fix the load error" The agent opened the file and found that a lock was held for too long.', [task]) < 0.4
    assert P.echo_share("", [task]) == P.echo_share("ab", [task]) == 0.0


@pytest.fixture(scope="module")
def model():
    rnd = random.Random(1)
    rows = []
    for lang, t in PROSE.items():
        for _ in range(12):
            w = t.split()
            rnd.shuffle(w)
            rows.append((t * 2 + " ".join(w), lang))
    return P.fit_languages([*rows, (DE * 3, "en")])


def test_languages(model):
    for a, x in PROSE.items():
        for b, y in PROSE.items():
            assert P.other_language(x * 2, y * 2, model) == (a != b)
    assert not P.other_language(EN * 3, EN + 'The log shows "' + RU + '".', model)
    assert not P.other_language(EN, "`a_b` 12", model)


def test_truncation():
    ended, seen, counts = Counter(), Counter(), Counter()
    for t in [EN * 2 + "\n- The agent opened `a` and found `b`\n- No files have been changed so far\n- Two tests still fail\n\n```\ncode\n```"] * 8:
        P.end_counts(t, ended, seen, counts)
    P.word_counts(counts, ended, seen)
    cut = [EN + "The agent read the fi", EN + "The agent read the file and", EN + "It then opened `src/ma", EN + "```python\ndef f(", EN + "and then the ...[truncated]", EN + "because the <max tokens>", "- Two tests still fail\n- ", "- Two tests still fail\n- `", "- The agent opened `a` (quota,", "1. Two tests still fail\n2. No files have"]
    whole = [EN, "- Two tests still fail\n- No files have been changed so far", EN + "\n```\nx = 1\n```", EN + "`a/b.py`", ZH, '"Quoted." ' + EN, EN.strip() + "\n\n1. The agent opened `x` and found `y`", EN + "The output was [truncated] in the log, which hides 4 lines."]
    assert [t for t in cut if not P.is_truncated(t, ended, seen)] == []
    assert [t for t in whole if P.is_truncated(t, ended, seen)] == []


def test_defects_in_spark(spark):
    step = [("assistant", "I looked at the store and changed the limit of the queue."), ("tool", "ok"), None, ("assistant", None)]
    rows = [("a", EN, step, EN + ES, "s"), ("b", EN, step, None, "s"), ("c", EN, step, "I cannot comply with this request.", "s"), ("d", EN, step, "I LOOKED AT THE STORE and changed the limit of the queue", "s"), ("e", EN * 2, None, DE * 2, "s"), ("f", None, [], EN + "It then opened `src/ma", "s"), ("b", EN, step, None, "s"), (None, EN, step, "", "s"), ("g", EN, step, EN.replace("file", "log") * 500, "s")]
    df = spark.createDataFrame(rows, "trajectory_id string, task string, steps array<struct<role:string,content:string>>, summary string, defect string")
    docs = spark.createDataFrame([(t + t[k:], x, "c") for x, t in PROSE.items() for k in range(8)] + [(None, "en", "c"), ("x", None, "c")], "text string, lang string, code string")
    got = {(r.trajectory_id, r.defect) for r in P.defects(df, docs).collect()}
    assert got >= {("b", "empty"), ("c", "refusal"), ("d", "echo"), ("e", "other_language"), ("f", "truncated"), (None, "empty")}
    assert ("g", "other_language") not in got
    assert P.defects(df.limit(0), docs.limit(0)).count() == 0


def test_cjk_blocks_are_compared_too():
    assert Q.verdict("王小明\n李建国\n张丽华\n陈志强\n刘海燕\n赵文博") == "list"
    assert Q.verdict("佐藤健一\n鈴木花子\n高橋誠\n田中美咲\n伊藤翔太") == "list"
    assert Q.verdict("".join(chr(0x4E00 + i * 7919 % 20900) for i in range(200))) == "junk"
    assert Q.verdict("我们在这个目录中找到了问题\n但是测试还没有通过\n所以需要再看一下日志\n然后把结果写到文件里") == "prose"
    assert Q.verdict("修改后的程序已经能够读取配置，\n但测试仍然失败。\n原因是路径不对。") == "prose"
    assert Q.verdict("テストは失敗しました。\n設定ファイルが見つからないためです。\n次にログを確認します。") == "prose"


def test_lines_in_fences_count_by_their_marks():
    dump = "\n".join(f"{i * 16:08x}: " + " ".join(f"{i * 7 + j * 331 & 0xFFFF:04x}" for j in range(8)) for i in range(12))
    rows = "\n".join(f"| {i} | name{i} | {i * 37} |" for i in range(12))
    entries = "\n".join(f"- entry number {i} of {i * 31}" for i in range(12))
    for body, form in ((dump, "junk"), (rows, "table"), (entries, "list")):
        assert Q.verdict(f"```\n{body}\n```") == form
        assert Q.verdict(f"Short words before it.\n```\n{body}") == form
    assert Q.verdict("```python\nx = [1, 2]\nfor y in x:\n    print(y)\n```") == "prose"
    assert Q.verdict("```diff\n- a line that was there\n- another one of them\n+ a line that came\n```") == "prose"
    assert Q.verdict("```\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n- a line that was there\n\nkept\n- another one of them\n+ a line that came\n```") == "prose"
    said = "We looked at the log and it is clear that the test fails because the path is wrong. "
    assert Q.verdict(f"{said}\n```\ndef f(x):\n    return x\nf(3)\n{'y = f(3)' + chr(10)}") == "prose"


def test_counts_of_ngrams_are_not_shared():
    words = [f"w{i:x}" for i in range(20_000)]
    assert len({k for w in words for k in P.end_contexts([w], 0)}) == 5 * len(words) + 1  # the one with gaps is the same for all


def test_distributed_counts_decide_as_the_whole_model(spark):
    texts = ["The fix was applied to the parser"] * 4 + ["The fix was applied to the"] + [f"- Ran the tests of part {i}" for i in range(5)] + ["Broken off (", "", None]
    df = spark.createDataFrame([(f"k{i}", "What was done?", [], t) for i, t in enumerate(texts)], "trajectory_id string, task string, steps array<struct<role:string,content:string>>, summary string")
    labelled = spark.createDataFrame([("the parser was fixed and the tests ran", "en")], "text string, lang string")
    ended, seen, counts = Counter(), Counter(), Counter()
    for t in texts:
        P.end_counts(t, ended, seen, counts)
    P.word_counts(counts, ended, seen)
    model = P.fit_languages([("the parser was fixed and the tests ran", "en")])
    want = {(f"k{i}", d) for i, t in enumerate(texts) if (d := P.defect_of("What was done?", [], t, model, ended, seen))}
    assert {tuple(r) for r in P.defects(df, labelled).collect()} == want
    assert {d for _, d in want} == {"empty", "truncated"}


def test_long_noisy_items_take_little_time():
    import time

    rnd = random.Random(14)
    item = words(rnd, 20_000)
    noisy = [w if rnd.random() > 0.07 else "other" for w in item]
    began = time.process_time()
    (found,) = L.search([" ".join(noisy)], L.build_index([(1, "p", " ".join(item))]))
    assert found[3] > 19_000
    assert found[3] >= L.RATE * found[4]
    assert time.process_time() - began < 5


def test_classes_of_items_by_size(spark):
    assert [L.size_class(n) for n in (20, 39, 40, 79, 80, 20_000)] == [0, 0, 1, 1, 2, 9]
    assert [L.width_of(n) for n in (20, 30, 50, 100)] == [2, 3, 4, 5]
    for n in range(20, 40):  # the fewest intact stretches of six words that changes can leave
        c = n // L.RATE
        assert L.least_hits(20, 2) <= n - c - 5 * (c + 1)
    rnd = random.Random(15)
    small, large = words(rnd, 24), words(rnd, 200)
    d = spark.createDataFrame([(1, " ".join(small)), (2, " ".join(large[50:80])), (3, " ".join(large[20:140]))], "doc_id long, text string")
    i = spark.createDataFrame([(1, " ".join(small)), (2, " ".join(large))], "item_id long, a string")
    assert {(r.doc_key, r.item_key) for r in L.leaks(d, "doc_id", "text", i, "item_id", ["a"]).collect()} == {(1, 1), (2, 2), (3, 2)}
    assert {(r.doc_key, r.item_key, r.n_words) for r in L.leaks(d, "doc_id", "text", i, "item_id", ["a"], min_share=0.5).collect()} == {(1, 1, 24), (3, 2, 120)}


def test_recall_against_brute_force():
    rnd = random.Random(16)
    item = words(rnd, 60)
    index, found, want = L.build_index([(1, "p", " ".join(item))]), 0, 0
    for _ in range(150):
        at = rnd.randint(0, 40)
        passage = item[at : at + 20]
        for x in rnd.sample(range(1, 19), 2):
            passage[x] = "changed"
        if best_by_brute_force(passage, item, L.RATE) >= L.MIN_WORDS:
            want += 1
            found += bool(L.search([" ".join(["a", "b", *passage, "c"])], index))
    assert want > 100
    assert found == want


def test_who_cannot_do_a_thing_of_the_run_describes_it():
    fine = ["I cannot reproduce the failure after the patch; all 42 tests pass.", "We could not find the config, so I patched the loader.", "I do not touch the parser. The fix is in lexer.py.", "We cannot merge until CI is green."]
    assert [t for t in fine if P.is_refusal(t)] == []


def test_likelihood_decides_of_texts_of_several_sentences():
    ended, seen, counts = Counter(), Counter(), Counter()
    for t in [EN + "Two tests still fail\n" + EN] * 8 + [EN + "Two tests of the store"] * 2:
        P.end_counts(t, ended, seen, counts)
    P.word_counts(counts, ended, seen)
    assert not P.is_truncated(EN + "Two tests still fail", ended, seen)
    assert P.is_truncated(EN + "Two tests still", ended, seen)
    assert P.is_truncated(EN + "Nobody knows", ended, seen)


def test_posteriors(model):
    assert P.posteriors("", model) == pytest.approx([1 / len(P.LANGUAGES)] * len(P.LANGUAGES))
    assert P.posteriors(ZH, model).argmax() == P.LANGUAGES.index("zh")
    assert P.other_language(EN * 2, "函数使测试能够通过", model)
    assert not P.other_language(EN * 2, "`a` 12", model)


def test_words_held_at_once_are_bounded(spark, monkeypatch):
    df = spark.createDataFrame([(f"w{i}x w{i}y w{i}z. The end of it",) for i in range(300)], "r string")
    whole = {tuple(r) for r in P.end_model(df, "r").collect()}
    monkeypatch.setattr(P, "HELD", 50)
    assert {tuple(r) for r in P.end_model(df, "r").collect()} == whole


def test_any_period_is_found():
    unit = "abcdefghijklmnop 1 abcdefghijklmnop 2 abcdefghijklmnop 3; "  # its first characters come again within it
    assert Q._repeated(unit * 4, Q._WORD.findall(unit * 4))
    assert Q.verdict(unit * 4) == "junk"


def test_profiles_are_fitted():
    rows = "\n".join(f"| {i} | name{i} | {i * 37} |" for i in range(12))
    texts = [EN * 5 + f" It was run {i} that failed." for i in range(60)] + [f"# part {i}\n" + rows + f"\nThe table shows run {i}." for i in range(60)]
    made = Q.fit_profiles([*texts, None, " ", "word " * 500])
    assert made.prose["en"] != Q.START.prose["en"]
    assert made.prose["de"] == Q.START.prose["de"]
    assert made.structure["table"] != Q.START.structure["table"]
    assert made.structure["junk"] == Q.START.structure["junk"]
    assert all(sum(p) == pytest.approx(1) for p in [*made.structure.values(), *made.prose.values()])
    assert {Q.measures(t, made)[-1] for t in texts[:60]} == {"prose"}
    assert {Q.measures(t, made)[-1] for t in texts[60:]} == {"table"}


def test_profiles_are_fitted_on_all_documents(spark):
    rows = "\n".join(f"| {i} | name{i} |" for i in range(9))
    more = [f"{rows}\n\n{EN * n}" for n in (2, 3)]  # more prose than table
    few = [f"{rows}\n\n{EN} Run {i}." for i in range(40)]
    texts = [f"{EN}It was run {i}, and it failed." for i in range(7000)] + few + more + [None, " ", "word " * 500, ZH]
    fitted = Q.fit_profiles(texts)
    expected = [Q.measures(t, fitted) for t in texts]
    assert {m[-1] for m in expected[7040:7042]} == {"table"}
    assert {Q.verdict(t) for t in more} == {"prose"}  # so they stay where the profiles are fitted on less than 30 of the 40
    df = spark.createDataFrame(list(enumerate(texts)), "no int, text string")
    for parts in (3, 7):
        got = {r[0]: tuple(r[1:]) for r in Q.text_statistics(df.repartition(parts), "no", "text").collect()}
        assert [got[i] for i in range(len(texts))] == expected


def test_fit_of_stored_readings(spark):
    names = ["parser", "lexer", "token", "scope", "symbol", "buffer", "stream", "socket", "kernel", "module", "branch"]
    texts = [PROSE[k] * 2 + f"{i}." for k in PROSE for i in range(20)] + ["\n".join(f"{names[j]} {names[(i + j) % 11]}" for j in range(9)) for i in range(40)]
    whole = Q.fit_profiles(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "no int, text string")
    made = [Q.fit_stored(Q.readings(rows, "no", "text")) for rows in (df.repartition(5), df.orderBy(F.reverse("text")))]
    assert made[0] == made[1]
    assert made[0][:3] == whole[:3]
    assert whole.bare != Q.START.bare
    assert whole.prose["de"] != Q.START.prose["de"]
    for form in Q.FORMS:
        assert made[0].structure[form] == pytest.approx(whole.structure[form], abs=1e-12)
