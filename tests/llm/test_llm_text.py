"""Languages on held-out messages, personal information on a small hand-made corpus."""

import random

import pytest

pytest.importorskip("memlake.llm")

from memlake.llm import languages, pii  # noqa: E402

SENTENCES = {
    "en": ["The {0} of {1} moved to another place last week", "Please remember that {1} must never wait for the {0}", "What do you think about the {0} that we wrote", "I would rather have short answers about {1}"],
    "de": ["Wir haben beschlossen, dass {1} ohne diese Prüfung auskommt", "Bitte merke dir, dass der Wert für {1} jetzt anders ist", "Niemand darf das ändern, solange {1} noch läuft", "Kurze Antworten über {1} sind mir lieber"],
    "fr": ["Nous avons décidé que {1} remplace le rapport dès demain", "Je préfère des réponses courtes sur {1} pour le moment", "Personne ne doit toucher à cela tant que {1} travaille", "Qu'est-ce que tu en penses aujourd'hui"],
    "es": ["Hemos decidido que {1} sustituye al informe desde hoy", "Prefiero respuestas cortas sobre {1} por ahora", "Nadie debe tocar esto mientras {1} siga con tareas", "Recuerda que el ajuste de {1} está ahora en otro lugar"],
    "pt": ["Nós decidimos que {1} substitui o relatório a partir de hoje", "Prefiro respostas curtas sobre {1} por enquanto", "Ninguém deve mexer nisso enquanto {1} ainda tiver tarefas", "Não esqueça que o ajuste de {1} agora fica em outro lugar"],
    "ru": ["Мы решили, что {1} заменит отчёт с завтрашнего дня", "Я предпочитаю короткие ответы про {1}", "Никто не должен это трогать, пока {1} работает"],
    "zh": ["我们决定从现在开始用{1}代替原来的报告", "我希望{1}的设置一直保持不变", "谁都不要动这个文件"],
    "ja": ["{1}についての答えは短めにしてほしいです", "今は{1}が応答しないので再起動します", "これは前にメモしたものではありません"],
    "ko": ["{1}의 값은 그대로 유지해 주세요", "우리 팀은 내일 {1}를 점검합니다", "이것은 전에 적어 둔 것이 아닙니다"],
}


def corpus(seed, n, wrong):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        la = rng.choice(list(SENTENCES))
        s = rng.choice(SENTENCES[la]).format(rng.choice(["queue", "cache", "index"]), rng.choice(["Takume", "Roshi", "Benado", "Zukari"])) + ("。" if la in ("zh", "ja") else ".")
        rows.append((f"m{i}", s, rng.choice(list(SENTENCES)) if rng.random() < wrong else la, la))
    return rows


def test_languages_with_wrong_labels(spark):
    rows = corpus(1, 900, 0.15)
    model = languages.train(spark.createDataFrame([r[:3] for r in rows], "id string, message string, language string"))
    held = corpus(2, 200, 0)
    found = languages.label_stretches(spark.createDataFrame([(k, s, 5) for k, s, *_ in held], "id string, message string, lang int"), model, "message", "id").collect()
    got = {r.rec_key: r.lang for r in found}
    assert sum(got[k] == la for k, _, _, la in held) >= 0.97 * len(held)
    assert all(0 <= r.confidence <= 1 for r in found)


def test_stretches_and_words(spark):
    model = languages.fit([(s, la) for _, s, _, la in corpus(3, 900, 0.1)])
    texts = [
        ("mix", "Please remember that Takume must never wait for the queue. 我希望Takume的设置一直保持不变。 Niemand darf das ändern, solange Takume noch läuft."), ("none", "✅ 3/3"), ("url", "https://x.example/1"), ("blank", "  "), ("empty", ""), (None, "Hello"), ("null", None),
        ("code", "```\nport = 1\n``` Wir haben beschlossen, dass `src/a.py` ohne diese Prüfung auskommt."), ("long", "Je préfère des réponses courtes sur Roshi pour le moment. " * 3000),
    ]
    rows = languages.label_stretches(spark.createDataFrame(texts, "id string, t string"), model, "t", "id").collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.rec_key, r.seg_no)):
        got.setdefault(r.rec_key, []).append(r.lang)
    assert got == {"mix": ["en", "zh", "de"], "none": ["und"], "url": ["und"], "blank": ["und"], "empty": ["und"], "code": ["de"], "long": ["fr"]}


def test_no_labels_at_all(spark):
    model = languages.train(spark.createDataFrame([("a", "text", None)], "id string, message string, language string"))
    rows = languages.label_stretches(spark.createDataFrame([("a", "some words")], "id string, t string"), model, "t", "id").collect()
    assert [(r.lang, r.seg_no) for r in rows] == [("und", 1)]


def pii_corpus():
    names = ["Grace Drumlow", "Corwin Wexholm", "Grace Wexholm", "Corwin Drumlow"]
    new = ["Ilka Ombers", "Wilf Velder"]
    rows = []
    for i in range(96):
        n = names[i % 4] if i % 3 else new[i % 2]
        rows.append((f"k{i}", f"The invoice of {n} still shows {10 + i} Old Heron Lane as the address.", f"Call me on +1415555{1000 + i} if the job hangs." if i % 2 else f"Call me on 0415.55{1000 + i} if the job hangs.", f"Write to {n.split()[0].lower()}.{i}@mail.site.example please. Ticket 1234-{1000 + i} covers Tamozu Ridu."))
    return rows


def test_personal_information(spark):
    rows = pii_corpus()
    schema = "storage_key string, content string, raw_text string, original_message string"
    df = spark.createDataFrame(rows + rows[:3] + [("e", None, "", "  "), (None, "a@b.example", None, None), ("l", "x " * 40_000, None, None)], schema)
    parts = spark.createDataFrame([("Grace", "given"), ("Corwin", "given"), ("Drumlow", "family"), ("Wexholm", "family"), (None, "given")], "name_part string, kind string")
    items = pii.find_items(df, parts).collect()
    assert sum(r.seed for r in items) <= len(items) / 2  # most are discovered
    got = {(r.mem_key, r.text_field, r.kind, r.pii) for r in items}
    want = set()
    for k, c, r, o in rows:
        want |= {(k, "content", "name", c.split(" of ")[1].split(" still")[0]), (k, "content", "address", c.split("shows ")[1].split(" as")[0]), (k, "raw_text", "phone", r.split(" on ")[1].split(" if")[0]), (k, "original_message", "email", o.split(" to ")[1].split(" please")[0])}
    assert got == want
    out = {r.storage_key: r for r in pii.redact(df, pii.find_items(df, parts)).collect()}
    assert out["k1"].content == "The invoice of [NAME] still shows [ADDRESS] as the address."
    assert out["e"].content is None and out["e"].raw_text == "" and out["e"].original_message == "  "
    assert len(out) == len(rows) + 2


def test_no_memories(spark):
    df = spark.createDataFrame([], "storage_key string, content string, raw_text string, original_message string")
    parts = spark.createDataFrame([], "name_part string, kind string")
    assert pii.find_items(df, parts).count() == 0


def test_rare_contexts_of_names_count_in_large_inputs(spark):
    parts = spark.createDataFrame([(p, "family") for p in "王李"] + [(p, "given") for p in ("伟", "芳", "强")], "name_part string, kind string")
    rows = [(f"h{i}", "今天客户王伟先生来。" * 30) for i in range(75)] + [(f"g{i}", "今天客户李芳先生来。" * 30) for i in range(75)]
    rows += [(f"r{i}", f"本项目负责人{x}签字了。") for i, x in enumerate(("王伟", "李芳", "王强", "李伟"))] + [("new", "本项目负责人赵敏签字了。")]
    df = spark.createDataFrame([(k, t, None, None) for k, t in rows], "storage_key string, content string, raw_text string, original_message string")
    found = [{tuple(r)[:6] for r in pii.find_items(df, parts, most_contexts=n).collect()} for n in (1000, 0)]
    assert ("name", "赵敏") in {(r[2], r[5]) for r in found[0] if r[0] == "new"}
    assert found[0] == found[1]


FOREIGN = (
    "Il gatto dorme sul divano mentre fuori piove forte.", "Domani andiamo al mercato per comprare il pane fresco.", "Preferisco lavorare la mattina presto quando tutto è tranquillo.",
    "De kat slaapt op de bank terwijl het buiten hard regent.", "Morgen gaan we naar de markt om vers brood te kopen.",
    "Kot śpi na kanapie, podczas gdy na zewnątrz mocno pada.", "Nie pamiętam, gdzie położyłem klucze od samochodu.",
    "Kedi kanepede uyuyor, dışarıda yağmur yağıyor.", "Yarın taze ekmek almak için pazara gidiyoruz.",
    "Kissa nukkuu sohvalla kun ulkona sataa kovasti.", "Huomenna menemme torille ostamaan tuoretta leipää.",
    "القطة تنام على الأريكة بينما تمطر في الخارج", "xkqz wvtr plmq zzxw qwrt bnvk lkjh", "asdf qwer zxcv hjkl uiop vbnm tyui", "blorp snarf quix zendle frumious wibble",
)
EN = "/root/testdata/sf0.1/en.parquet"


def labelled():
    pd = pytest.importorskip("pandas")
    try:
        df = pd.read_parquet(EN).drop_duplicates("id").sort_values("id")
    except OSError:
        pytest.skip("needs the labelled messages")
    df = df[df["message"].notna() & df["language"].isin(languages.LANGUAGES)]
    return list(zip(df["message"], df["language"]))


def stretches_of(model, score, text):
    spans, words = [], []
    for s, e, x in languages.sentences(text):
        words.append(languages.words_of(x))
        spans.append((s, e, languages.n_words(words[-1])))
    return languages.stretches(spans, score(words), model)


def test_other_languages_are_rejected_and_confidence_tells_accuracy():
    rows = labelled()
    model, rest = languages.fit(rows[:3000]), rows[3000:5000]
    score = languages.Scorer(model)
    far = [stretches_of(model, score, t)[0][2] for t in FOREIGN]
    assert far.count("und") >= 0.9 * len(far)
    by = {}
    kept = 0
    for text, la in rest:
        found = stretches_of(model, score, text)
        kept += any(x[2] == la for x in found)
        if len(found) == 1 and found[0][2] != "und":
            by.setdefault(int(10 * found[0][3]), []).append((found[0][2] == la, found[0][3]))
    # labels are wrong here and there, hence the margins
    assert kept >= 0.8 * len(rest)
    for xs in by.values():
        if len(xs) >= 50:
            assert abs(sum(x for x, _ in xs) / len(xs) - sum(c for _, c in xs) / len(xs)) < 0.2
