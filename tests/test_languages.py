"""Languages by trigram profiles."""

import pytest

from echoloom.functions import languages as L

TEXTS = {
    "en": ["This is an English sentence.", "The queue at the clinic was too long and nobody told us why."],
    "fr": ["C'est une phrase française.", "Nous n'avons pas reçu de nourriture depuis la semaine dernière."],
    "es": ["Esta es una oración en español.", "El agua llega muy tarde y los niños tienen sed."],
    "uk": ["Це речення українською.", "Ми не отримали допомоги вже третій тиждень."],
    "ru": ["Это предложение на русском.", "Мы не получили помощи уже третью неделю."],
    "de": ["Das Wasser ist seit gestern schlecht und niemand sagt uns etwas.", "Wir brauchen mehr Decken für die Kinder."],
    "nl": ["Het water is sinds gisteren slecht en niemand vertelt ons iets.", "Wij hebben geen dekens voor de kinderen gekregen."],
    "ar": ["لم نحصل على الماء منذ أسبوع وهذا صعب على الأطفال.", "نحن في حاجة إلى الدواء في هذه المدينة."],
    "it": ["Non abbiamo ricevuto il cibo e i bambini sono malati."],
    "pt": ["As crianças não têm água e ninguém nos disse porquê."],
    "pl": ["Dzieci nie mają wody i nikt nam nie powiedział dlaczego."],
    "xx": ["asdkjhasdkjh asdkljhasd asdkljhasd", "", None, "12345 !?", "qwrtzx vbnmkl"],
}


@pytest.fixture(scope="module")
def rows():
    return [(f"{lang}-{k}", text) for lang, texts in TEXTS.items() for k, text in enumerate(texts)]


def test_languages_are_told_apart(spark, rows):
    df = spark.createDataFrame([*rows, rows[0]], "id string, t string").repartition(3)
    got = [tuple(x) for x in L.detect_language(df, "id", "t").collect()]
    assert len(got) == len(rows) + 1
    assert [x for x in got if x[1] != x[0][:2]] == []
    assert all(x[2] == (x[1] if x[1] in L.SUPPORTED else "xx") for x in got)


def test_long_texts_and_a_plain_sum(spark, rows):
    weight = {}
    for lang, gram, w in L.profiles():
        weight.setdefault(gram, {})[lang] = w
    text = "La lluvia Ñandú, por la mañana! " * 3000
    df = spark.createDataFrame([("a", text), ("b", "für")], "id string, t string")
    got = {x.id: x.detected for x in L.detect_language(df, "id", "t").collect()}
    for key, t in (("a", text), ("b", "für")):
        words = " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
        grams = [words[k : k + 3] for k in range(len(words) - 2)]
        sums = {lang: sum(weight.get(g, {}).get(lang, 0) for g in grams) for lang in L.SAMPLES}
        best = min(sums, key=lambda x: (-sums[x], x))
        hits = sum(best in weight.get(g, {}) for g in grams)
        assert got[key] == (best if 100 * hits >= len(grams) * L.LEAST_SHARE else "xx")


def test_most_documents_are_in_their_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = L.detect_language(docs, "doc_id", "text").join(docs.select("doc_id", "lang"), "doc_id")
    right, n = got.where("detected = lang").count(), docs.count()
    assert right >= 0.9 * n
