"""The language of a text from character trigrams: profiles are counted from short samples, texts meet them in batches."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Of each language the first article of the Universal Declaration of Human Rights, then frequent words.
SAMPLES = {
    "ar": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء "
    "في من على إلى عن أن هذا هذه التي الذي كان لا ما مع كل بعد قبل بين عند لم قد هو هي نحن هناك",
    "de": "alle menschen sind frei und gleich an würde und rechten geboren sie sind mit vernunft und gewissen begabt und sollen einander im geist der brüderlichkeit begegnen "
    "der die das und ist nicht ein eine zu mit den von im für auf sich dem des es auch wir haben wurde werden nach bei aus sehr schlecht wasser kinder über noch",
    "en": "all human beings are born free and equal in dignity and rights they are endowed with reason and conscience and should act towards one another in a spirit of brotherhood "
    "the of and to in is that for it with as was on be by this are from at or an have not they we there which their people when what could would about been sentence english",
    "es": "todos los seres humanos nacen libres e iguales en dignidad y derechos y dotados como están de razón y conciencia deben comportarse fraternalmente los unos con los otros "
    "el la los las de que y en un una por con para del se no es al lo como su esta está hay pero más muy cuando también oración español porque agua niños",
    "fr": "tous les êtres humains naissent libres et égaux en dignité et en droits ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité "
    "le la les des et une un est du que qui dans pour par sur au en ne pas il nous vous avec cette ce sont mais plus très quand aussi phrase française parce eau enfants c'est",
    "it": "tutti gli esseri umani nascono liberi ed eguali in dignità e diritti essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza "
    "il lo la i gli le di che e un una per con non è del della sono nel anche come più questo questa ma molto quando perché acqua bambini abbiamo",
    "nl": "alle mensen worden vrij en gelijk in waardigheid en rechten geboren zij zijn begiftigd met verstand en geweten en behoren zich jegens elkander in een geest van broederschap te gedragen "
    "de het een en van is dat niet te op voor met zijn aan er ook maar als bij om uit door naar heeft hebben wij deze zeer slecht water kinderen over nog geen wordt",
    "pl": "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa "
    "i w na z do nie się że to jest o jak po co od przez dla ale czy już był tylko bardzo kiedy także woda dzieci mamy tego",
    "pt": "todos os seres humanos nascem livres e iguais em dignidade e em direitos dotados de razão e de consciência devem agir uns para com os outros em espírito de fraternidade "
    "o a os as de que e em um uma por com para do da se não é ao no na como mais mas muito quando também porque água crianças nós você isso está",
    "ru": "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства "
    "и в не на что с по это как но из у за от для так же все его она они мы был быть очень когда также вода дети предложение русском потому есть нет уже ещё этот эта эти который чтобы даже может можно надо день год работа город первый новый",
    "uk": "всі люди народжуються вільними і рівними у своїй гідності та правах вони наділені розумом і совістю і повинні діяти у відношенні один до одного в дусі братерства "
    "і в не на що з по це як але із у за від для так же всі його вона вони ми був бути дуже коли також вода діти речення українською тому є немає та вже ще цей ця ці який щоб навіть може можна треба день рік робота місто перший новий",
}
#: Languages that the rest of the pipeline knows; any other is UNKNOWN there.
SUPPORTED = ("en", "es", "fr", "ru", "uk")
UNKNOWN = "xx"
#: A text is of a language if so much of it, in percent of its trigrams, is in that language's profile.
LEAST_SHARE = 25


def profiles() -> list[tuple[str, str, int]]:
    """(language, trigram, weight): weight is 100 ln(1 + a thousand times the trigram's share of its sample), to the next integer."""
    out = []
    for lang, sample in sorted(SAMPLES.items()):
        text = f" {' '.join(sample.replace(chr(39), ' ').split())} "
        counts = Counter(text[k : k + 3] for k in range(len(text) - 2))
        out += [(lang, g, round(100 * math.log1p(1000 * n / sum(counts.values())))) for g, n in sorted(counts.items())]
    return out


def letters(text: Column) -> Column:
    """A text's lower-cased letters; anything else between two words counts as one blank, as do both ends."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]+", " ")
    return F.concat(F.lit(" "), F.trim(plain), F.lit(" "))


def _tables():
    """Languages; classes of code points (0: in no profile); the profiles' row of three classes (0: none); weights by row and language."""
    import numpy as np

    rows = profiles()
    langs = sorted({lang for lang, _, _ in rows})
    points = sorted({ord(c) for _, g, _ in rows for c in g})
    classes = np.zeros(0x110000, dtype=np.int32)
    classes[points] = np.arange(1, len(points) + 1)
    size = len(points) + 1
    grams = {g: k for k, g in enumerate(sorted({g for _, g, _ in rows}), 1)}
    at = np.zeros(size**3, dtype=np.int16)
    weights = np.zeros((len(grams) + 1, len(langs)), dtype=np.int64)
    for g, k in grams.items():
        a, b, c = (int(classes[ord(x)]) for x in g)
        at[(a * size + b) * size + c] = k
    for lang, g, w in rows:
        weights[grams[g], langs.index(lang)] = w
    return langs, classes, size, at, weights


def _best(text: str, langs, classes, size, at, weights) -> tuple[str | None, int, int]:
    """The language of most weight (ties by code), the trigrams of its profile that the text holds, and all of its trigrams."""
    import numpy as np

    c = classes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    n = max(len(c) - 2, 0)
    held = np.bincount(at[(c[:n] * size + c[1 : n + 1]) * size + c[2 : n + 2]], minlength=len(weights))
    held[0] = 0
    met = held @ (weights > 0)
    if not met.any():
        return None, 0, n
    k = int(np.argmax(np.where(met > 0, held @ weights, -1)))
    return langs[k], int(met[k]), n


def detect_language(df: DataFrame, id_col: str, col: str, least_share: int = LEAST_SHARE, supported: tuple[str, ...] = SUPPORTED) -> DataFrame:
    """(id, detected, language) of each row: the language whose profile gives the text's trigrams the largest sum of weights, ties by
    code, xx if less than least_share of a hundred of them are in it; and the same with xx for languages that are not supported.

    The profiles are about 3,000 rows of a fixed table. Trigrams are counted where a text lies, so nothing is shuffled. A null or
    empty text, or one without letters, is xx. Rows that repeat an id are detected each for itself.
    """
    from pyspark.sql.types import StringType, StructField, StructType

    def run(batches):
        import pyarrow as pa

        tables = _tables()
        for b in batches:
            found = [_best(t.as_py(), *tables) for t in b.column(1)]
            names = [lang if lang and hits * 100 >= n * least_share else UNKNOWN for lang, hits, n in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string())], names=[id_col, "detected"])

    rows = df.select(F.col(id_col), letters(F.col(col)).alias("_t"))
    found = rows.mapInArrow(run, StructType([rows.schema[id_col], StructField("detected", StringType())]))
    return found.withColumn("language", F.when(F.col("detected").isin(*supported), F.col("detected")).otherwise(UNKNOWN))
