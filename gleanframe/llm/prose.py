"""Per-document text quality statistics and a verdict on natural prose, by an induced rule list.

The statistics are column expressions. An ordered list of rules over them is induced on labelled documents by incremental reduced-error
pruning: grow a rule on two thirds of the documents by information gain, prune it on the rest while its precision rises, keep it, remove
what it covers, repeat. The list is exported as one SQL CASE expression (:data:`RULES`) and applied to all documents by Spark itself.

The tables hold no labels, so the labelled documents are written here by a small grammar (:func:`labelled`): sentences of many languages
and scripts, and of made-up ones, in many layouts, against lists, tables, machine output and noise in the same scripts, and mixtures of
both. A third of the sentences are of languages whose function words are on no list, so that no rule can rest on knowing them.
"""

from __future__ import annotations

import random
import unicodedata
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanframe.functions.vectors import let
from gleanframe.session import col

# Frequent function words of European languages.
COMMON = sorted(set("""
the of and to in is was for that with it as on at by not but we this be are from one they their two were if you he she his her have has had or an a i no so
der die das und ein eine wir von am im den dem nicht mit zu ist auf aus für war doch weil nur
le la les et un une des du que pour pas dans ne sur ce cette il en est au car nous
el los las y de por con se del es al pero lo como su más
il lo gli di che è per non sono una della nel
o os as um uma do da em não que com para
het een van de en dat niet is op te zijn voor
och att det som en på är av för inte
i w na z się nie że do to jest
""".split()))  # fmt: skip

FEATURES = [
    "words", "mean_word", "symbol_ratio", "digit_ratio", "common_ratio", "line_end_ratio", "list_ratio", "table_ratio", "words_per_line",
    "vowel_ratio", "longest_word", "distinct_ratio", "delimiter_ratio", "mixed_ratio", "letter_ratio", "sentence_ratio", "caps_ratio",
]
# what rules may ask for: statistics that mean the same in every language, without lists of words
NEUTRAL = [f for f in FEATURES if f not in ("common_ratio", "distinct_ratio", "longest_word", "mixed_ratio")]

# every accented Latin letter with a plain base, by rule
_ACCENTED = "".join(c for c in map(chr, range(0xC0, 0x250)) if len(unicodedata.normalize("NFD", c)) > 1 and unicodedata.normalize("NFD", c)[0].isascii())
_BASES = "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED)
# letters of scripts that set no blanks between words; two of them count as a word
_SOLID = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3041-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}]"

_LIST = r"(?U)^\s*(?:[-*+•·▪◦‣–—]|\(?\d{1,4}[.):]|\(?[A-Za-z][.)]|\[[ xX✓]?\])\s+\S"


def statistics(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``<doc>`` and one column per name in :data:`FEATURES`, computed over the whole text.

    words: runs of non-blank characters, in scripts without blanks pairs of letters; mean_word, longest_word: their lengths; symbol_ratio, digit_ratio: characters that are neither
    letter, mark nor digit, or digits, of all non-blank ones; common_ratio: words that are frequent function words; line_end_ratio: lines
    ending in closing punctuation; list_ratio: share of characters in lines that start like list entries; table_ratio: share of
    characters in lines with several cells; words_per_line; vowel_ratio: vowels of all basic Latin letters (0.4 where there are under
    20, accents aside); distinct_ratio: different words of all; delimiter_ratio: cell marks per word; mixed_ratio: words that mix letters
    with digits or cases; letter_ratio: letters and marks of all non-blank characters; sentence_ratio: sentence ends per word; caps_ratio:
    words that begin with a capital.

    Defined cases: a NULL, empty or blank text has 0 words and 0 in every column (vowel_ratio 0.4); texts of any length are read whole;
    repeated rows give repeated rows; further columns are ignored; an empty table gives no rows.
    """
    base = docs.select(col(doc).alias("id"), F.coalesce(col(text).cast("string"), F.lit("")).alias("t"))
    # markup tags carry no words
    base = base.withColumn("t", F.regexp_replace("t", r"</?[A-Za-z][^<>]*>", ""))
    # texts of ASCII alone need no Unicode classes here, which are slower
    base = base.withColumn("ascii", F.octet_length("t") == F.char_length("t"))
    base = base.withColumn("t", F.when(F.col("ascii"), F.col("t")).otherwise(F.regexp_replace("t", r"\p{Cf}+", "")))
    # single blanks stay as they are, so only line ends and runs are rewritten
    wide, narrow = r"(?U)[\s\p{Z}]{2,}|[\s\p{Z}&&[^ ]]", r"\s{2,}|[\t\n\r\f\x0B]"
    # scripts without blanks are cut into pairs of letters
    base = base.withColumn("lines", F.col("t")).withColumn("t", F.when(F.col("ascii") | ~F.col("t").rlike(_SOLID), F.col("t")).otherwise(F.regexp_replace("t", f"{_SOLID}{{1,2}}", " $0 ")))
    base = base.withColumn("flat", F.trim(F.when(F.col("ascii"), F.regexp_replace("t", narrow, " ")).otherwise(F.regexp_replace("t", wide, " "))))
    base = base.withColumn("w", F.when(F.col("flat") == "", F.array().cast("array<string>")).otherwise(F.split("flat", " ")))
    base = base.withColumn("solid_text", F.regexp_replace("flat", r"[^\p{L}\p{M}\p{Nd} ]+", ""))
    base = base.withColumn("bare", F.lower("solid_text"))
    folded = F.when(F.col("ascii"), F.col("bare")).otherwise(F.translate("bare", _ACCENTED, _BASES))
    base = base.withColumn("bare", F.filter(F.split(folded, " "), lambda x: x != ""))
    # ASCII texts have no other line ends than these two, and a cut at one character needs no pattern; blank lines are dropped anyway
    lines = F.when(F.col("ascii"), F.split(F.replace("lines", F.lit("\r"), F.lit("\n")), "\n")).otherwise(F.split("lines", r"\r\n|[\n\r\u0085\u2028\u2029]"))
    base = base.withColumn("ln", F.filter(lines, lambda x: x.rlike(r"(?U)[^\s\p{Z}\p{Cf}]")))
    # blanks of the flat text stand between its words, so words are counted without cutting them out
    n = F.when(F.col("flat") == "", 0).otherwise(F.octet_length("flat") - F.octet_length(F.replace("flat", F.lit(" "), F.lit(""))) + 1)
    base = base.withColumn("n_words", n)
    n = F.col("n_words")
    solid = F.greatest(F.char_length("flat") - n + 1, F.lit(0))

    def share(a: Column, b: Column) -> Column:
        """0 for nothing of nothing; not a condition, in which Spark would make equal parts of several columns anew."""
        return a * (b > 0).cast("int") / F.greatest(b, F.lit(1))

    def held(pred) -> Column:
        """Characters in the lines for which ``pred`` holds."""
        return F.aggregate("ln", F.lit(0), lambda acc, x: acc + F.when(pred(x), F.char_length(x)).otherwise(0))

    # counts of characters are lengths before and after removing their runs
    of = lambda runs, c="flat": F.char_length(c) - F.char_length(F.regexp_replace(c, runs, ""))
    base = base.withColumn("n_symbols", F.char_length("flat") - F.char_length("solid_text"))
    base = base.withColumn("n_digits", of(r"\p{Nd}+", "solid_text"))
    base = base.withColumn("n_letters", F.greatest(solid - F.col("n_symbols") - F.col("n_digits"), F.lit(0)))
    # Latin letters are all letters of an ASCII text
    base = base.withColumn("plain", F.when(F.col("ascii"), F.col("solid_text")).otherwise(F.translate("solid_text", _ACCENTED + "ıøæœ", _BASES + "ioao")))
    base = base.withColumn("latin", F.when(F.col("ascii"), F.col("n_letters")).otherwise(of("[A-Za-z]+", "plain")))
    latin, vowels = F.col("latin"), of("[AEIOUYaeiouy]+", "plain")
    # classes of ASCII marks alone are looked up in a table, which others are not
    plainly = lambda a, b: F.when(F.col("ascii"), a).otherwise(b)
    cells = lambda x: plainly(F.regexp_count(x, F.lit(r"[|\t;,/]| {3,}")), F.regexp_count(x, F.lit(r"[|\t;,/·‖、，；،]| {3,}")))
    lines_of = held(lambda x: F.lit(True))
    frequent = sorted({x.translate(str.maketrans(_ACCENTED, _BASES)) for x in COMMON})
    return base.select(
        F.col("id").alias(doc),
        n.cast("double").alias("words"),
        share(solid, n).alias("mean_word"),
        share(F.col("n_symbols"), solid).alias("symbol_ratio"),
        share(F.col("n_digits"), solid).alias("digit_ratio"),
        share(F.size(F.filter("bare", lambda x: x.isin(frequent))), n).alias("common_ratio"),
        share(F.size(F.filter("ln", lambda x: F.right(F.rtrim(x), F.lit(12)).rlike(r"(?U)[.!?…:;。！？؟][\"'”’»)\]*_]*\s*$"))), F.size("ln")).alias("line_end_ratio"),
        share(held(lambda x: x.rlike(_LIST)), lines_of).alias("list_ratio"),
        share(held(lambda x: let(cells(x), lambda c: (c >= 2) & (F.regexp_count(x, F.lit(r"\S+")) <= 3 * c))), lines_of).alias("table_ratio"),
        share(n, F.size("ln")).alias("words_per_line"),
        F.when(latin >= 20, vowels / latin).otherwise(0.4).alias("vowel_ratio"),
        F.coalesce(F.array_max(F.transform("w", F.char_length)), F.lit(0)).cast("double").alias("longest_word"),
        share(F.size(F.array_distinct("bare")), n).alias("distinct_ratio"),
        share(plainly(of(r"[|\t;,/#={}\[\]<>\\]+", "lines"), of(r"[|\t;,/·‖、，；،#={}\[\]<>\\]+", "lines")), n).alias("delimiter_ratio"),
        share(F.size(F.filter("w", lambda x: x.rlike(r"\p{L}\p{Nd}|\p{Nd}\p{L}|\p{Ll}\p{Lu}"))), n).alias("mixed_ratio"),
        share(F.col("n_letters"), solid).alias("letter_ratio"),
        share(plainly(F.regexp_count("flat", F.lit(r"[.!?](?<=[A-Za-z].)[.!?]*(?= |$)")), F.regexp_count("flat", F.lit(r"[.!?…](?<=\p{L}.)[.!?…]*(?= |$)|[。！？।؟]"))), n).alias("sentence_ratio"),
        share(F.regexp_count("flat", F.lit(r"(?:^| )\p{Lu}")), n).alias("caps_ratio"),
    )


# ---- labelled documents -------------------------------------------------------------------------------------------------------------

# Sentence frames and fillers of the grammar.
_FRAMES = [
    ("{S} {v} the {o} while the {p} was {a}.", "en"), ("We {v} a {a} {o} near the {p}, and it was not the first one.", "en"),
    ("I think that the {o} is too {a} for this {p}, but you may keep it.", "en"), ("In the {p} there were {n} of them, so they {v} the {o}.", "en"),
    ("If the {o} is {a}, do not change the {p} at once.", "en"), ("Der {O} im {P} war nicht so {A}, und wir {V} von da an zu dem Haus.", "de"),
    ("Wir {V} die {O} nur, weil das Licht am {P} {A} ist.", "de"), ("La {o2} du {p2} est {a2}, car nous ne {v2} pas dans la pluie.", "fr"),
    ("Il y a {n} {o2} sur le {p2} et une {o2} {a2}.", "fr"), ("El {o3} de la {p3} es {a3}, pero no se {v3} por la tarde.", "es"),
    ("Con {n} {o3} en el {p3} la foto es más {a3} que las otras.", "es"), ("Il {o4} della {p4} non è {a4}, ma lo {v4} per la luce.", "it"),
    ("De {o5} van het {p5} is niet {a5}, dus wij {v5} een andere.", "nl"), ("Det är {a6} att se en {o6} på {p6} som inte {v6}.", "sv"),
    ("O {o7} do {p7} não é {a7}, e nós {v7} com uma câmera para a noite.", "pt"),
]
_FILL = {
    "S": "She|My friend|The guide|Nobody|A visitor|The whole group".split("|"), "v": "watched|followed|painted|described|missed|counted|liked".split("|"),
    "o": "bridge|market|letter|garden|train|window|story|storm|picture|boat".split("|"), "p": "harbour|village|kitchen|valley|station|forest|square".split("|"),
    "a": "quiet|late|bright|strange|old|cold|narrow|gentle|broken".split("|"), "O": "Garten|Brief|Zug|Turm|Sturm".split("|"), "P": "Hafen|Dorf|Wald|Tal|Markt".split("|"),
    "A": "leise|alt|hell|seltsam|kalt".split("|"), "V": "sahen|malten|zählten|suchten".split("|"), "o2": "lettre|maison|fenêtre|histoire|barque".split("|"),
    "p2": "port|village|jardin|marché".split("|"), "a2": "ancienne|froide|calme|étrange".split("|"), "v2": "voyons|peignons|cherchons".split("|"),
    "o3": "puente|barco|jardín|tren|cuento".split("|"), "p3": "plaza|estación|cocina|orilla".split("|"), "a3": "viejo|claro|raro|frío".split("|"), "v3": "mira|pinta|cuenta|busca".split("|"),
    "o4": "ponte|treno|giardino".split("|"), "p4": "città|stazione|casa".split("|"), "a4": "vecchio|freddo|chiaro".split("|"), "v4": "guardo|cerco|disegno".split("|"),
    "o5": "brief|trein|tuin|storm".split("|"), "p5": "dorp|bos|huis".split("|"), "a5": "oud|koud|stil".split("|"), "v5": "zien|zoeken|tellen".split("|"),
    "o6": "bro|båt|trädgård".split("|"), "p6": "torget|stationen|stranden".split("|"), "a6": "konstigt|fint|svårt".split("|"), "v6": "syns|rör sig|finns".split("|"),
    "o7": "barco|trem|jardim".split("|"), "p7": "porto|mercado|vale".split("|"), "a7": "velho|frio|claro".split("|"), "v7": "vimos|pintamos|contamos".split("|"),
    "n": [str(i) for i in range(2, 90)],
}
# Four parts of simple sentences of further languages: who, did, what, and a clause; the order, marks and blanks between them.
_PARTS = {
    "ru": ("Мой друг|Старый рыбак|Наша соседка|Никто из нас|Тот мальчик", "долго смотрел на|не нашёл|нарисовал|забыл про|ждал у", "реку за домом|письмо на столе|старый мост в лесу|поезд из города|свет в окне", "потому что шёл дождь|когда стало темно|и ушёл домой|хотя было холодно|а потом мы пили чай"),
    "uk": ("Мій брат|Стара жінка|Ніхто з нас", "довго шукав|не бачив|чекав на", "міст через річку|лист від матері|човен біля берега", "бо йшов дощ|коли стемніло|і пішов додому"),
    "el": ("Ο φίλος μου|Η γειτόνισσα|Κανείς από εμάς|Ο γέρος ψαράς", "κοίταζε|δεν βρήκε|ζωγράφισε|ξέχασε", "το παλιό γεφύρι|το γράμμα στο τραπέζι|το φως στο παράθυρο|τη βάρκα στο λιμάνι", "γιατί έβρεχε πολύ|όταν νύχτωσε|και γύρισε στο σπίτι|αν και έκανε κρύο"),
    "bg": ("Моят приятел|Старата жена|Никой от нас", "дълго гледаше|не намери|забрави за", "реката зад къщата|писмото на масата|лодката до брега", "защото валеше|когато се стъмни|и се прибра"),
    "tr": ("Arkadaşım|Yaşlı balıkçı|Komşumuz|Hiçbirimiz", "eski köprüyü|masadaki mektubu|ormandaki evi|penceredeki ışığı", "uzun süre aradı|bulamadı|resmetti|unutmadı", "çünkü yağmur yağıyordu|hava karardığında|ama eve döndü|sonra çay içtik"),
    "fi": ("Ystäväni|Vanha kalastaja|Naapurimme|Kukaan meistä", "katseli pitkään|ei löytänyt|maalasi|unohti", "vanhaa siltaa metsässä|kirjeen pöydältä|valon ikkunassa|veneen rannalla", "koska ulkona satoi|kun tuli pimeä|ja lähti kotiin|vaikka oli kylmä"),
    "hu": ("A barátom|Az öreg halász|Senki közülünk", "sokáig nézte|nem találta|elfelejtette", "a régi hidat az erdőben|a levelet az asztalon|a fényt az ablakban", "mert esett az eső|amikor besötétedett|és hazament"),
    "cs": ("Můj přítel|Starý rybář|Nikdo z nás", "dlouho hledal|nenašel|zapomněl na", "starý most v lese|dopis na stole|světlo v okně", "protože pršelo|když se setmělo|a šel domů"),
    "id": ("Teman saya|Nelayan tua itu|Tidak seorang pun", "melihat|tidak menemukan|melukis|melupakan", "jembatan lama di hutan|surat di atas meja|cahaya di jendela", "karena hujan turun|ketika hari gelap|lalu pulang ke rumah"),
    "vi": ("Bạn tôi|Ông lão đánh cá|Không ai trong chúng tôi", "nhìn mãi|không tìm thấy|đã vẽ|quên mất", "cây cầu cũ trong rừng|lá thư trên bàn|ánh sáng bên cửa sổ", "vì trời mưa|khi trời tối|rồi về nhà"),
    "sw": ("Rafiki yangu|Mvuvi mzee|Hakuna mmoja wetu", "alitazama|hakuona|alichora|alisahau", "daraja la zamani msituni|barua juu ya meza|taa dirishani", "kwa sababu mvua ilinyesha|giza lilipoingia|kisha akaenda nyumbani"),
    "hi": ("मेरा दोस्त|बूढ़ा मछुआरा|हमारी पड़ोसन|हम में से कोई", "जंगल का पुराना पुल|मेज़ पर रखी चिट्ठी|खिड़की की रोशनी|नदी के किनारे नाव", "देर तक देखता रहा|नहीं ढूँढ सका|भूल गया|बनाता रहा", "क्योंकि बारिश हो रही थी|जब अँधेरा हुआ|और घर चला गया|फिर भी ठंड थी"),
    "ar": ("صديقي|الصياد العجوز|جارتنا|لا أحد منا", "نظر طويلا إلى|لم يجد|رسم|نسي", "الجسر القديم في الغابة|الرسالة على الطاولة|الضوء في النافذة|القارب عند الشاطئ", "لأن المطر كان يهطل|عندما حل الظلام|ثم عاد إلى البيت|رغم البرد"),
    "he": ("החבר שלי|הדייג הזקן|אף אחד מאיתנו", "הביט זמן רב על|לא מצא את|שכח את", "הגשר הישן ביער|המכתב על השולחן|האור בחלון", "כי ירד גשם|כשהחשיך|והלך הביתה"),
    "ko": ("내 친구는|늙은 어부는|우리 이웃은|아무도", "숲속의 오래된 다리를|책상 위의 편지를|창가의 불빛을|강가의 배를", "오랫동안 바라보았다|찾지 못했다|그렸다|잊어버렸다", "비가 왔기 때문이다|날이 어두워졌다|그리고 집에 갔다"),
    "zh": ("我的朋友|那位老渔夫|我们的邻居|谁也", "一直看着|没有找到|画下了|忘记了", "树林里的旧桥|桌上的信|窗边的灯光|河边的小船", "因为外面下着雨|天黑的时候|然后就回家了|虽然天气很冷"),
    "ja": ("私の友だちは|年老いた漁師は|隣の人は|誰も", "森の古い橋を|机の上の手紙を|窓の明かりを|川辺の舟を", "長い間見ていた|見つけられなかった|描いていた|忘れてしまった", "雨が降っていたから|暗くなると|そして家に帰った"),
    "th": ("เพื่อนของฉัน|ชาวประมงแก่|ไม่มีใคร", "มองดู|หาไม่เจอ|วาดรูป", "สะพานเก่าในป่า|จดหมายบนโต๊ะ|แสงไฟที่หน้าต่าง", "เพราะฝนตก|เมื่อฟ้ามืด|แล้วกลับบ้าน"),
}
_MARKS = {"zh": ("，", "。", ""), "ja": ("、", "。", ""), "hi": (", ", "।", " "), "ar": ("، ", ".", " "), "th": (" ", " ", "")}
# letters of other scripts that stand for Latin ones in made-up languages, by rule
_SCRIPTS = {"cyrillic": ("аеиоуыэ", "бвгджзклмнпрстфхцчш"), "greek": ("αειουηω", "βγδζθκλμνξπρστφχψ"), "latin": ("aeiouy", "bcdfghjklmnprstvz"), "armenian": ("աեիոու", "բգդզթժլխծկհձղճմյնշ"), "georgian": ("აეიოუ", "ბგდვზთკლმნპჟრსტფქღყ")}
_BULLETS = ["- ", "* ", "• ", "+ ", "[ ] ", "[x] ", "n. ", "n) ", "– ", ""]


def _made_up(r: random.Random, texts: list[str]) -> list[str]:
    """The texts in a language no one speaks: vowels and consonants changed for others of one script, ends of words kept alike."""
    vowels, consonants = (list(x) for x in _SCRIPTS[r.choice(sorted(_SCRIPTS))])
    r.shuffle(vowels), r.shuffle(consonants)
    turn = {c: vowels[i % len(vowels)] for i, c in enumerate("aeiouy")} | {c: consonants[i % len(consonants)] for i, c in enumerate("bcdfghjklmnpqrstvwxz")}
    turn |= {k.upper(): v.upper() for k, v in turn.items()}
    if r.random() < 0.35:  # a language of long words
        texts = [" ".join("".join(w[i : i + 2]) for i in range(0, len(w), 2)) for w in (x.split(" ") for x in texts)]
    return [unicodedata.normalize("NFD", x).translate(str.maketrans(turn)) for x in texts]


def _foreign(r: random.Random, n: int) -> tuple[list[str], str]:
    lang = r.choice(sorted(_PARTS))
    parts = [p.split("|") for p in _PARTS[lang]]
    comma, stop, gap = _MARKS.get(lang, (", ", ".", " "))
    out = []
    for _ in range(n):
        who, did, what, clause = (r.choice(p) for p in parts)
        s = gap.join([who, did, what])
        if r.random() < 0.7:
            s += comma + clause
        if r.random() < 0.2:
            s += comma + r.choice(parts[3])
        out.append(s + stop)
    return out, lang


def _sentences(r: random.Random, n: int) -> list[str]:
    draw = r.random()
    if draw < 0.3:
        return _foreign(r, n)[0]
    lang = r.choice(["en"] * 5 + ["de", "fr", "es", "it", "nl", "sv", "pt"])
    frames = [f for f, g in _FRAMES if g == lang]
    out = []
    for _ in range(n):
        f = r.choice(frames)
        while "{" in f:
            k = f[f.index("{") + 1 : f.index("}")]
            f = f.replace("{" + k + "}", r.choice(_FILL[k]), 1)
        out.append(f)
    filler = [w for k in ("a", "o", "p") if lang == "en" for w in _FILL[k]] or [w for k in _FILL if k[-1:].isdigit() or k.isupper() for w in _FILL[k] if " " not in w]
    extra = r.choice([0.0, 0.1, 0.2, 0.35, 0.5])  # wordier sentences hold a smaller share of function words
    out = [" ".join(x + (" " + r.choice(filler) if r.random() < extra else "") for x in f.split(" ")) for f in out]
    return _made_up(r, out) if draw < 0.42 else out


def _words(r: random.Random) -> list[str]:
    """Words a list or a table may hold, of one language or script."""
    if r.random() < 0.6:
        return [w for k in ("o", "p", "a", "O", "o2", "o3", "o4") for w in _FILL[k]]
    if r.random() < 0.4:
        return [w.lower() for w in _made_up(r, [w for k in ("o", "p", "a") for w in _FILL[k]])]
    lang = r.choice(sorted(_PARTS))
    parts = [x for p in _PARTS[lang] for x in p.split("|")]
    if lang in ("zh", "ja", "th"):
        return [x[i : i + r.randrange(2, 4)] for x in parts for i in range(0, max(1, len(x) - 2), 2)]
    return [w for x in parts for w in x.split(" ") if len(w) > 2]


def _prose(r: random.Random, n: int) -> str:
    s = _sentences(r, n)
    style = r.randrange(9)
    if style == 0:  # no capitals or full stops
        s = [x.lower().rstrip(".") for x in s]
    if style == 1:  # one sentence a line
        return "\n".join(s)
    text = " ".join(s)
    if style == 2 and " " not in text.strip():
        width = r.randrange(15, 40)
        return "\n".join(text[i : i + width] for i in range(0, len(text), width))
    if style == 2:  # hard-wrapped
        w, lines = text.split(), [""]
        width = r.randrange(30, 75)
        for x in w:
            if len(lines[-1]) + len(x) > width:
                lines.append("")
            lines[-1] += x + " "
        return "\n".join(lines)
    if style == 3:  # markup
        return "<p>" + "</p>\n<p>".join(s) + "</p>"
    if style == 4:
        return "\n".join("> " + x for x in s)
    if style == 5:
        return text.replace(". ", "... ").replace("the", "teh")
    if style == 6:  # loose marks between words
        return " ".join(x + r.choice(["", "", "", " -", " /", " |", ",", " **", "!"]) for x in text.split())
    if style == 7:
        return "\n\n".join(" ".join(s[i : i + 3]) for i in range(0, len(s), 3))
    return text


def _token(r: random.Random, word: str) -> str:
    return r.choice([word, word, str(r.randrange(10000)), f"{r.random():.4f}", f"20{r.randrange(10, 30)}-{r.randrange(10, 13)}-{r.randrange(10, 28)}", f"{word}_{r.randrange(9999)}.jpg", f"1/{r.randrange(20, 999)}", "", "n/a"])


def _junk(r: random.Random, n: int) -> str:
    kind = r.randrange(25)
    vocabulary = _words(r)
    word = lambda: r.choice(vocabulary)
    if kind in (0, 1, 2, 23, 24):
        b = r.choice(_BULLETS)
        entry = [lambda: word(), lambda: f"{word()} {word()}", lambda: f"{r.choice(_FILL['v'])} {word()} {r.randrange(400)}", lambda: f"{word()} x{r.randrange(40)}", lambda: f"{word()}, {word()}", lambda: f"{word()} {word()} {word()} {r.randrange(400)}", lambda: " ".join(word() for _ in range(r.randrange(3, 7)))]
        e = r.choice(entry)
        head = r.choice(["", "", f"We still need the {word()} of the {word()}.\n", f"{word()} for {word()}:\n".capitalize()])
        return head + "\n".join(b.replace("n", str(i + 1)) + e() for i in range(n))
    if kind in (3, 4, 5):
        sep, cols = r.choice([",", ";", "\t", " | ", "||", "   "]), r.randrange(3, 9)
        return "\n".join(sep.join(_token(r, word()) for _ in range(cols)) for _ in range(n))
    if kind == 6:
        return "\n".join(f"{r.randrange(24):02}:{r.randrange(60):02}:{r.randrange(60):02}.{r.randrange(999):03} {r.choice(['INFO', 'WARN', 'ERROR', 'DEBUG'])} {word()}[{r.randrange(9)}] {word()}=0x{r.getrandbits(32):08x} t={r.random():.4f}" for _ in range(n))
    if kind == 7:
        return "{" + ", ".join(f'"{word()}_{i}": {r.choice(["null", r.randrange(9999), round(r.random(), 4)])}' for i in range(2 * n)) + "}"
    if kind == 8:
        return "\n".join(f"/{word()}/{word()[:3]}{r.randrange(99)}/img_{r.randrange(99999)}.{r.choice(['jpg', 'orf', 'xmp'])}" for _ in range(n))
    if kind == 9:
        chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
        return r.choice(["\n", ""]).join("".join(r.choice(chars) for _ in range(76)) for _ in range(max(2, n // 2)))
    if kind == 10:
        m = r.choice(["#", "-", "=", "*", "?!", "/\\", "_ ", ". ", "~", "%&"])
        return "\n".join(m * r.randrange(6, 40) for _ in range(n))
    if kind == 11:
        return " ".join("".join(r.choice("bcdfghjklmnpqrstvwxyzae") for _ in range(r.randrange(3, 12))) for _ in range(6 * n))
    if kind in (16, 17):  # a text worn beyond reading
        rate, marks = r.uniform(0.3, 0.7), r.choice(["#%*^~|{}[]<>=_:;°§'\\", "ÂÃâåïœ™€¢¤¶¼½¿", "\ufffd?"])
        return "".join(r.choice(marks) if r.random() < rate else c for c in " ".join(_sentences(r, max(2, n // 2))))
    if kind == 18:
        return "".join(r.choice("ÂÃâåïœ™€¢¤¶¼½¿ ") for _ in range(20 * n))
    if kind == 13:
        return "\n".join(f"{16 * i:08x}  " + " ".join(f"{r.randrange(256):02x}" for _ in range(16)) for i in range(n))
    if kind == 14:
        return "\n".join(f"{'  ' * r.randrange(3)}{word()}.{word()}({r.randrange(99)}, {word()}={r.random():.3f});" for _ in range(n))
    if kind == 15:
        return "\n".join(f"{word()}_{word()}: {_token(r, word())}" for _ in range(n))
    if kind in (12, 21, 22):
        return r.choice([" / ", ", ", " · ", " | ", "; ", "、", " #"]).join(word() for _ in range(r.randrange(8, 70)))
    if kind == 19:
        return "\n".join(f"{word()} {word()}" if r.random() < 0.8 else word() for _ in range(n))
    if kind == 20:
        return "\n".join(f"{word()}{r.choice([': ', ' x', ' - ', ' = '])}{r.randrange(60)}" for _ in range(n))
    return "".join(r.choice("abcdefgh0123456789#$%&*()[]{}<>?/\\~^") for _ in range(30 * n))


def labelled(n: int = 16000, seed: int = 7) -> list[tuple[int, str, bool]]:
    """``(number, text, is junk)``: prose, junk, and mixtures labelled by what makes up most of the text."""
    r, out = random.Random(seed), []
    for i in range(n):
        kind = r.random()
        if kind < 0.35:
            out.append((i, _prose(r, r.choice([1, 1, 2, 2, 3, 4, 6, 9, 14, 22])), False))
        elif kind < 0.65:
            out.append((i, _junk(r, r.randrange(5, 40)), True))
        else:
            a, b = _prose(r, r.choice([1, 1, 2, 3, 5, 8, 13, 21])), _junk(r, r.randrange(3, 30))
            share = len(b) / (len(a) + len(b))
            if 0.4 < share < 0.6:
                continue
            out.append((i, f"{a}\n{b}" if r.random() < 0.7 else f"{b}\n{a}", share > 0.5))
    return out


# ---- the rule learner ----------------------------------------------------------------------------------------------------------------

Condition = tuple[int, bool, float]  # feature, at most (else at least), threshold


def covers(rule: Sequence[Condition], x: np.ndarray) -> np.ndarray:
    m = np.ones(len(x), dtype=bool)
    for f, below, t in rule:
        m &= (x[:, f] <= t) if below else (x[:, f] >= t)
    return m


def _grow(x: np.ndarray, y: np.ndarray, most: int) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < most and len(y) and not y.all():
        p0, n0 = y.sum(), (~y).sum()
        if not p0:
            break
        before, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            if len(values) < 2:
                continue
            if len(values) > 64:
                values = np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)))
            for t in (values[:-1] + values[1:]) / 2:
                low = x[:, f] <= t
                for below, m in ((True, low), (False, ~low)):
                    p, q = (y & m).sum(), (~y & m).sum()
                    if p and p + q < len(y):
                        gain = p * (np.log2(p / (p + q)) - before)
                        if gain > best[0]:
                            best = (gain, (f, below, float(t)))
        if best[1] is None:
            break
        rule.append(best[1])
        m = covers([best[1]], x)
        x, y = x[m], y[m]
    return rule


def _worth(rule, x, y) -> float:
    m = covers(rule, x)
    p, n = (y & m).sum(), (~y & m).sum()
    return (p - n) / (p + n + 2)  # a rule that covers few documents is not trusted


def induce(x: np.ndarray, y: np.ndarray, seed: int = 11, most_rules: int = 24, most_conditions: int = 4, precision: float = 0.85) -> list[list[Condition]]:
    """An ordered rule list for the true class by incremental reduced-error pruning; anything no rule covers is of the other class."""
    rng, rules = np.random.default_rng(seed), []
    left = np.arange(len(y))
    failed = 0
    while len(rules) < most_rules and y[left].any() and failed < 15:
        mix = rng.permutation(left)
        cut = 2 * len(mix) // 3
        grow, prune = mix[:cut], mix[cut:]
        rule = _grow(x[grow], y[grow], most_conditions)
        if not rule:
            failed += 1
            continue
        best = max(range(1, len(rule) + 1), key=lambda k: (_worth(rule[:k], x[prune], y[prune]), -k))
        rule = rule[:best]
        if _worth(rule, x[prune], y[prune]) <= precision:
            failed += 1
            continue
        rules.append(rule)
        left = left[~covers(rule, x[left])]
    return rules


def to_case(rules: Sequence[Sequence[Condition]], names: Sequence[str] = FEATURES) -> str:
    """The rule list as a SQL CASE expression: true where a rule covers a document, else false; blank documents first."""
    when = ["WHEN words = 0 THEN true"]
    for rule in rules:
        when.append("WHEN " + " AND ".join(f"{names[f]} {'<=' if below else '>='} {t!r}D" for f, below, t in rule) + " THEN true")
    return "CASE " + " ".join(when) + " ELSE false END"


def learn(spark: SparkSession, n: int = 16000, seed: int = 7) -> str:
    """The CASE expression learned on at most ``n`` labelled documents (a bounded sample by construction)."""
    docs = pd.DataFrame(labelled(n, seed), columns=["no", "text", "junk"])
    seen = statistics(spark.createDataFrame(docs), "no", "text").toPandas().merge(docs[["no", "junk"]], on="no").sort_values("no")
    x, y = seen[NEUTRAL].to_numpy(float), seen.junk.to_numpy(bool)
    # the split into growing and pruning documents is random: of several lists the one that errs least on documents kept aside
    aside = np.arange(len(y)) % 4 == 0
    lists = [induce(x[~aside], y[~aside], s) for s in range(8)]
    wrong = lambda rules: int((np.any([covers(r, x[aside]) for r in rules], axis=0) != y[aside]).sum()) if rules else int(y[aside].sum())
    return to_case(min(lists, key=wrong), NEUTRAL)


# What :func:`learn` gives with its defaults.
RULES = (
    "CASE "
    "WHEN words = 0 THEN true "
    "WHEN sentence_ratio <= 0.03811594202898551D AND letter_ratio <= 0.8759590792838874D AND letter_ratio <= 0.6969399933717682D THEN true "
    "WHEN sentence_ratio <= 0.04046686045085486D AND letter_ratio <= 0.8951561969918276D AND words_per_line <= 5.557486979166667D AND words_per_line <= 4.085443606321839D THEN true "
    "WHEN sentence_ratio <= 0.030962597757738616D AND caps_ratio >= 0.010005159239853118D AND caps_ratio >= 0.05894785582954791D AND vowel_ratio <= 0.3997802478710162D THEN true "
    "WHEN mean_word >= 5.540098952696608D AND caps_ratio <= 0.0736988609844541D AND delimiter_ratio <= 0.050666292889721604D AND symbol_ratio <= 0.013230616322276664D THEN true "
    "WHEN letter_ratio <= 0.8891260030908801D AND mean_word >= 6.29726357748369D AND words <= 115.40625D AND symbol_ratio >= 0.1411948946832668D THEN true "
    "WHEN sentence_ratio <= 0.03963893249607535D AND symbol_ratio >= 0.045786378519782914D AND delimiter_ratio >= 0.2892945892723181D AND delimiter_ratio >= 0.4640547108673978D THEN true "
    "WHEN words_per_line <= 6.4436555232558135D AND sentence_ratio <= 0.024805298233270795D AND delimiter_ratio <= 0.0237546182763179D THEN true "
    "WHEN letter_ratio <= 0.9063411845088294D AND sentence_ratio <= 0.04897519954746714D AND table_ratio >= 0.4992391275417864D AND table_ratio <= 0.9768339768339769D THEN true "
    "WHEN letter_ratio <= 0.8943531042850241D AND mean_word >= 6.180343372388849D AND mean_word >= 10.013054452325406D THEN true "
    "WHEN list_ratio >= 0.4762130718857732D THEN true "
    "WHEN letter_ratio <= 0.7806352701496735D AND letter_ratio <= 0.6466494028738308D AND line_end_ratio >= 0.3875D THEN true ELSE false END"
)


def judge(docs: DataFrame, doc: str, text: str, rules: str = RULES) -> DataFrame:
    """The statistics and ``junk``: true for documents that are not natural prose. Cases as in :func:`statistics`; blank texts are junk."""
    return statistics(docs, doc, text).withColumn("junk", F.expr(rules))
