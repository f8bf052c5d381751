"""Labelled documents for learning what is natural prose: a bounded, seeded set, made without any table that is judged.

Its English is that of Python's language reference, which comes with Python (`pydoc_data`),
and of sentences on everyday matters; the other languages have everyday sentences. Around
them stand the layouts that prose comes in and the kinds of text that is none; a mixture is
labelled by what most of its characters are.
"""

from __future__ import annotations

import base64
import random
import re
from functools import lru_cache

#: How many documents are made; the bound of the labelled set.
LABELLED = 9000

THINGS = "bread ladder river kettle bicycle garden window letter train market orchestra lamp harbour recipe blanket engine forest bridge clock violin parcel ticket sandwich umbrella stove meadow lighthouse novel island carpet hammer basket tunnel museum vineyard kitchen mirror tractor suitcase newspaper".split()
KINDS = "old quiet wooden green crowded narrow cheap heavy bright empty foreign dusty gentle famous broken warm useful hidden second-hand well-kept".split()
DEEDS = "carries follows hides crosses replaces needs resembles outlasts ruins repairs borrows surprises".split()
PLACES = "Lisbon Bergen Kyoto Lima Cork Ghent Tartu Malmö Porto Graz".split()
PEOPLE = "Anna Bruno Clara Dimitri Elsa Felix Greta Hugo Irene Jonas".split()
#: Sentences of other languages, with a place for a number (#) and for a noun (@), and the nouns.
OTHER = {
    "de": ("Garten Zug Kuchen Fluss Wagen Markt Hund Brief Turm Wald Stuhl Berg", ["Der @ ist heute geschlossen.", "Wir haben den @ gestern gesehen, aber niemand war dort.", "Warum steht der @ im Regen?", "Im @ wohnen # Vögel und # Katzen.", "Meine Tante hat den @ verkauft, z. B. wegen der Kälte.", "Nach # Minuten kam der @ endlich an.", "Der @ gefällt mir besser als der alte, denn er ist leiser.", "Niemand weiß, wem der @ gehört.", "Am Abend gingen die Kinder zum @ und sangen."]),
    "fr": ("jardin train gâteau fleuve marché chien pont bateau four chemin vélo tapis", ["Le @ est fermé aujourd'hui.", "Nous avons vu le @ hier, mais il n'y avait personne.", "Pourquoi le @ reste-t-il sous la pluie ?", "Il y a # oiseaux et # chats près du @.", "Ma tante a vendu le @ pour # euros.", "Le @ est arrivé au bout de # minutes.", "Ce @ me plaît, car il fait moins de bruit que l'autre.", "Personne ne sait à qui est le @."]),
    "es": ("jardín tren pastel río mercado perro puente barco horno camino reloj", ["El @ está cerrado hoy.", "Ayer vimos el @, pero no había nadie.", "¿Por qué está el @ bajo la lluvia?", "Hay # pájaros y # gatos cerca del @.", "Mi tía vendió el @ por # euros.", "El @ llegó después de # minutos.", "Este @ me gusta más, porque hace menos ruido.", "Nadie sabe de quién es el @."]),
    "ru": ("сад поезд пирог рынок мост дом лес стол корабль", ["Сегодня @ закрыт.", "Мы вчера видели @, но там никого не было.", "Почему @ стоит под дождём?", "Около дома живут # птиц и # кошек.", "Тётя продала @ за # рублей.", "Через # минут @ наконец прибыл.", "Никто не знает, чей это @."]),
    "zh": ("花园 火车 蛋糕 市场 桥 小船 书店 钟楼 厨房 雨伞", ["今天@关门了。", "昨天我们看到了@，但是那里没有人。", "为什么@在雨里？", "附近有#只鸟和#只猫。", "我姑姑把@卖了#元。", "过了#分钟，@终于到了。", "这个@比旧的安静，所以我更喜欢。", "没有人知道@是谁的。"]),
    "ja": ("庭 電車 ケーキ 市場 橋 船 本屋 時計台 台所 傘", ["今日@は閉まっている。", "昨日@を見たが、誰もいなかった。", "なぜ@は雨の中にあるのか？", "近くに鳥が#羽と猫が#匹いる。", "叔母は@を#円で売った。", "#分後に@がやっと着いた。", "この@は前のより静かなので気に入っている。"]),
    "ar": ("القطار الجسر السوق البيت القارب الكتاب المطعم", ["المكان مغلق اليوم بسبب @.", "رأينا @ أمس، لكن لم يكن هناك أحد.", "لماذا يقف @ تحت المطر؟", "بالقرب منه # طائرا و # قطة.", "باعت عمتي @ بمبلغ # دينار.", "وصل @ بعد # دقيقة."]),
    "hi": ("बगीचा पुल बाज़ार घर नाव किताब", ["आज @ बंद है।", "हमने कल @ देखा, पर वहाँ कोई नहीं था।", "@ बारिश में क्यों है?", "पास में # पक्षी और # बिल्लियाँ हैं।", "मेरी बुआ ने @ को # रुपये में बेचा।", "# मिनट के बाद @ आ गया।"]),
    "th": ("สวน รถไฟ ตลาด สะพาน บ้าน เรือ หนังสือ ร่ม", ["วันนี้@ปิด", "เมื่อวานเราเห็น@แต่ไม่มีใครอยู่", "ทำไม@จึงอยู่กลางฝน", "ใกล้ ๆ มีนก # ตัวและแมว # ตัว", "ป้าของฉันขาย@ในราคา # บาท", "@มาถึงหลังจากนั้น # นาที"]),
    "el": ("κήπο δρόμο φούρνο σταθμό πύργο σκύλο μύλο", ["Σήμερα δεν είδα τον @.", "Χθες πήγαμε στον @, αλλά δεν ήταν κανείς εκεί.", "Γιατί αφήσατε τον @ στη βροχή;", "Κοντά στον @ ζουν # πουλιά και # γάτες.", "Η θεία μου πούλησε τον @ για # ευρώ.", "Κανείς δεν ξέρει τον @."]),
}


@lru_cache(maxsize=1)
def reference() -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(sentences, code blocks) of Python's language reference."""
    from pydoc_data.topics import topics

    sentences, code = [], []
    for name in sorted(topics):
        for block in topics[name].split("\n\n"):
            lines = [x for x in block.split("\n") if x.strip()]
            if not lines:
                continue
            if all(x.startswith("   ") for x in lines):
                if re.search(r">>>|::=|\w\(.*\):?$|^\s*(?:def|class|import|from|for|while|try|return)\b| = ", block, re.M) and not re.search(r"[a-z,] [a-z]+\n? +[a-z]+ [a-z]+ [a-z]+", block):
                    code.append(block.strip("\n"))
            elif len(block) > 80 and not any(x.startswith((" ", "*", "-", "+", "|", "=")) for x in lines) and "::=" not in block and block.rstrip().endswith("."):
                sentences += [s for s in re.split(r"(?<=[.])\s+(?=[A-Z])", " ".join(" ".join(lines).split())) if 20 < len(s) < 500]
    return tuple(sentences), tuple(code)


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def n(self) -> str:
        return self.r.choice(THINGS)

    def a(self) -> str:
        return self.r.choice(KINDS)

    def number(self) -> str:
        r = self.r
        return r.choice([f"{r.random():.2f}", f"{r.uniform(0, 40):.1f}", str(r.randrange(1, 99)), f"{r.randrange(1, 9)},{r.randrange(100, 999)}"])

    def sentence(self) -> str:
        """An English sentence on an everyday matter."""
        r, n, a, who = self.r, self.n, self.a, self.r.choice(PEOPLE)
        s = r.choice([
            lambda: f"The {a()} {n()} {r.choice(DEEDS)} the {n()} behind the {n()}",
            lambda: f"{who} left the {n()} in {r.choice(PLACES)} and never asked for it again",
            lambda: f"Of {self.number()} visitors only {self.number()} had seen the {n()} before",
            lambda: f"On page {r.randrange(99)} of the guide the {n()} costs {self.number()}, at the door it costs {self.number()}",
            lambda: f"Nobody remembers whether the {n()} or the {a()} {n()} came first",
            lambda: f"They measured {self.number()}, {self.number()} and {self.number()} metres from the {n()} to the {n()}",
            lambda: f"When the {a()} {n()} arrived in {r.choice(PLACES)}, {who} was already asleep under the {n()}",
            lambda: f"A {n()} is a {n()} that has learned patience", lambda: f"{who} sold {r.randrange(2, 90)} {n()}s",
            lambda: f'"Is that your {n()}?" asked {who}, and the whole {n()} went quiet', lambda: f"Mr. {who} met Dr. {r.choice(PEOPLE)} near the {n()}, i.e. too late",
            lambda: f"I would rather keep the {a()} {n()} than look for a {n()} that is {a()} and {a()}",
        ])()
        if len(s) > 40 and r.random() < 0.3:
            s = r.choice(["After the storm", "To be honest", f"During the {r.randrange(2, 40)} days of rain", "Later that year", f"As for the {n()}", "In the end"]) + ", " + s[0].lower() + s[1:]
        if len(s) > 40 and r.random() < 0.4:
            s += r.choice([", which pleased everyone", f", because the {n()} was {a()}", f", although {who} had promised a {n()}", f", and so the {n()} stayed where it was until the {a()} {n()} was found", f" and not the {n()} from {r.choice(PLACES)}"])
        return s + r.choice("....!")

    def foreign(self, lang: str) -> str:
        nouns, sentences = OTHER[lang]
        text = self.r.choice(sentences)
        while "#" in text:
            text = text.replace("#", self.number(), 1)
        return text.replace("@", self.r.choice(nouns.split()))

    def terse(self) -> str:
        r, n = self.r, self.n
        return r.choice([f"No {n()} today.", f"The {n()} stayed {self.a()}.", f"{self.r.choice(PEOPLE)} laughed.", f"Rain fell for {self.number()} hours.", f"{r.randrange(90)} guests came; {r.randrange(9)} left early.", f"The {n()} cost {self.number()}."])

    def written(self) -> str:
        """An English sentence: of the reference or an everyday one."""
        return self.r.choice(reference()[0]) if self.r.random() < 0.4 else self.sentence()

    def prose(self, size: int) -> str:
        r, out, at = self.r, [], 0
        terse = r.random() < 0.08
        lang = r.choice([*["en"] * 12, *OTHER, "th"])
        if lang != "en":
            # few sentences make a language here: one comes four times at most
            size = min(size * r.choice([1, 1, 3, 9]), 40 * len(OTHER[lang][0].split()) * len(OTHER[lang][1]) * 4)
        while at < size:
            s = self.terse() if terse else self.written() if lang == "en" or r.random() < 0.08 else self.foreign(lang)
            out.append(s)
            at += len(s) + 1
        glue = "" if lang in ("zh", "ja") else " "
        text, paragraph = [], r.randrange(2, 7)
        for i in range(0, len(out), paragraph):
            text.append(glue.join(out[i : i + paragraph]))
        look = r.random()
        if look < 0.25 and lang == "en":
            width = r.randrange(40, 92)
            text = [self.wrapped(p, width) for p in text]
        if look > 0.93:
            text = [f"{i + 1}. {p}" for i, p in enumerate(text)]
        whole = r.choice(["\n\n", "\n\n", "\n", "\r\n\r\n"]).join(text)
        if 0.3 < look < 0.36:
            whole = whole.upper() if r.random() < 0.5 else whole.lower()
        if 0.36 < look < 0.42:
            whole = "\n".join(f"[Page {i + 1}]\n{p}" for i, p in enumerate(text))
        if 0.42 < look < 0.48:
            whole = f"## The {self.a()} {self.n()}\n" + whole
        if 0.48 < look < 0.6:
            whole = whole[: -r.randrange(1, 30)] if len(whole) > 90 else whole.rstrip(".")
        if 0.6 < look < 0.66 and size > 400:
            whole += "\n\n" + self.junk(size // 4)[0]
        if 0.66 < look < 0.7:
            whole = "\n\n".join(p.rstrip(".!") for p in text)
        return whole

    def wrapped(self, text: str, width: int) -> str:
        lines, line = [], ""
        for w in text.split(" "):
            if line and len(line) + len(w) + 1 > width:
                lines.append(line)
                line = w
            else:
                line = f"{line} {w}".strip()
        return "\n".join([*lines, line])

    def fragment(self) -> str:
        r, n, a = self.r, self.n, self.a
        return r.choice([f"the {n()} beside the {a()} {n()}", f"{r.randrange(90)} {n()}s with their {n()}s", f"{n()} by town and by year, with the price", f"what to do with the {a()} {n()}", f"how to clean the {n()} on page {r.randrange(90)}", f"{a()} {n()}, {n()}", f"{n()}", f"{a()} {n()}", f"{n()} / {n()}", f"{n().capitalize()} ({a()} kind)", f"{n()}: {self.number()}"])

    def wide(self) -> str:
        """A row of many columns or one long item."""
        r = self.r
        return r.choice(["\t", " | ", ";", ","]).join([self.n(), *(self.number() if r.random() < 0.7 else f"{self.a()} {self.n()}" for _ in range(r.randrange(30, 90)))])

    def junk(self, size: int) -> tuple[str, str]:
        r, n, a = self.r, self.n, self.a
        number = self.number
        cell = lambda: r.choice([number(), number(), f"{number()} ({number()}, {number()})", f"{r.randrange(900)} ({r.uniform(0, 99):.1f}%)", f"{number()} [{number()}; {number()}]", n()])
        columns, mark = r.randrange(2, 8), r.choice(["- ", "• ", "* ", "– ", "", "", None, "()", "[ ] "])
        end = r.choice(["", "", ";", ",", "", "."])
        kind = r.choice("table columns spaces matrix wide key key references contents form list list words words salad salad commas bytes hex miscoded noisy broken spaced onebyone repeated repeated repeated code code footer log names urls".split())
        counted = iter(range(1, 100000))

        def item() -> str:
            if mark is None:
                return f"{next(counted)}. {self.fragment()}{end}"
            if mark == "()":
                return f"{next(counted)}) {self.fragment()}{end}"
            return f"{mark}{self.fragment()}{end}"

        sep = r.choice(["\t", ";", ",", " | ", " || "])
        shape = r.choice([lambda: f"[ ] {n()}", lambda: f"Do you own a {a()} {n()}? [ ] yes [ ] no", lambda: f"Is the {n()} {a()}? Y / N / NA", lambda: f"{n().capitalize()}: ________"])
        key = r.choice(["=", " = ", ": ", "\t"])
        author = lambda: f"{r.choice('Ames Brandt Costa Duval Engel Fabre Grant'.split())}, {r.choice('ABCDEH')}."
        ref = r.choice([
            lambda: f"[{next(counted)}] {author()}, {author()} ({r.randrange(1950, 2026)}). {a().capitalize()} {n()}s of {r.choice(PLACES)}. Journal of {n().capitalize()} History, {r.randrange(90)}({r.randrange(9)}), {r.randrange(90)}–{r.randrange(90, 190)}.",
            lambda: f"{author()} ({r.randrange(1950, 2026)}). The {a()} {n()}. Annals of the {n().capitalize()}, {r.randrange(90)}({r.randrange(9)}), {r.randrange(90)}-{r.randrange(99)}.",
            lambda: f"{next(counted)}. {author()} {a().capitalize()} {n()}s and {n()}s. Rev {n().capitalize()}. {r.randrange(1950, 2026)};{r.randrange(90)}({r.randrange(9)}):{r.randrange(90)}-{r.randrange(99)}.",
        ])
        words_of = [w for _ in range(30) for w in self.written().lower().replace(",", "").split()]
        glue = r.choice([" ", ", ", " ; ", "\n", " / "])
        one = r.choice([self.written(), f"The {n()} of {r.choice(PLACES)}, all rights reserved", f"Please turn over and read on about the {n()}."])
        if kind == "repeated":
            between = r.choice([" ", "\n", "\n\n"])
            return self.fill(lambda: one + between, size, ""), kind
        if kind in ("bytes", "hex"):
            raw = bytes(r.randrange(256) for _ in range(size * 3 // 4))
            text = base64.b64encode(raw).decode() if kind == "bytes" else raw[: size // 2].hex()
            return r.choice([text, "\n".join(text[i : i + 76] for i in range(0, len(text), 76))]), kind
        if kind == "miscoded":
            # text of other scripts, its bytes read one by one
            text = " ".join(self.foreign(r.choice(("ru", "zh", "ja", "el", "hi", "fr", "ar"))) for _ in range(max(2, size // 90)))
            return text.encode().decode("latin-1"), kind
        if kind in ("noisy", "broken", "spaced", "onebyone"):
            text = " ".join(self.written() for _ in range(max(2, size // (80 if kind != "spaced" else 160))))
            if kind == "spaced":
                return " ".join(c if c != " " else " " for c in text), kind
            if kind == "onebyone":
                step = r.choice([1, 1, 2])
                w = text.split()
                return r.choice(["\n", "\n", "\n\n"]).join(" ".join(w[i : i + step]) for i in range(0, len(w), step)), kind
            if kind == "broken":
                return "".join(c + r.choice([" ", " ", "\n", "- ", ". ", "-\n"]) if r.random() < 0.3 else c for c in text if c != " " or r.random() < 0.5), kind
            rate = r.uniform(0.15, 0.4)
            return "".join(r.choice("=~|_\\<>*#^°§¬¤¦") if r.random() < rate else c for c in text), kind
        if kind == "code" and r.random() < 0.6:
            return self.fill(lambda: r.choice(reference()[1]) + "\n", size, ""), kind
        make = {
            "table": lambda: "| " + " | ".join([n(), *(cell() for _ in range(columns))]) + " |\n", "columns": lambda: sep.join([n(), *(cell() for _ in range(columns))]) + "\n",
            "spaces": lambda: "   ".join([f"{n()} {n()}", *(cell() for _ in range(columns))]) + "\n", "matrix": lambda: " ".join(number() for _ in range(r.randrange(4, 10))) + "\n", "wide": lambda: self.wide() + "\n",
            "key": lambda: f"{n()}_{n()}{key}{r.choice([number(), 'ok', 'null', 'true', f'{r.getrandbits(48):012x}'])}\n", "references": lambda: ref() + "\n",
            "contents": lambda: f"{r.randrange(1, 9)}.{r.randrange(1, 9)} {a().capitalize()} {n()}s {r.choice(['.', '. ']) * r.randrange(6, 50)} {r.randrange(90)}\n", "form": lambda: shape() + "\n",
            "list": lambda: item() + "\n", "words": lambda: r.choice([n(), a(), n() + " " + n()]) + glue, "salad": lambda: r.choice(words_of).strip(".?!") + " ",
            "commas": lambda: r.choice(words_of).strip(".?!") + ", ", "code": lambda: r.choice([f"y{next(counted)} <- sapply({n()}s, function(v) v * {number()});\n", f"  while ({n()}.next() != null) {{ {n()} += {number()}; }}\n", f"SELECT {n()}, {n()} FROM {n()}s WHERE {n()} > {number()};\n"]),
            "footer": lambda: f"{one} {r.choice(['', 'Page ', '- '])}{next(counted)}\n", "log": lambda: f"2019-0{r.randrange(1, 9)}-1{r.randrange(9)} 1{r.randrange(9)}:{r.randrange(10, 59)}:{r.randrange(10, 59)} WARN {n()}.{n()} {n()}={number()} code={r.randrange(900)}\n",
            "names": lambda: f"{author()} {author()}; {n().capitalize()} Society, {r.choice(PLACES)}\n", "urls": lambda: f"https://example.invalid/{n()}/{n()}-{r.randrange(999)}\n",
        }[kind]
        return self.fill(make, size, "").rstrip(" ,;" if glue != "\n" else None) if kind in ("words", "commas") else self.fill(make, size, ""), kind

    def fill(self, make, size: int, text: str) -> str:
        while len(text) < size:
            text += make()
        return text.rstrip("\n")

    def document(self) -> tuple[str, bool]:
        """(text, whether it is prose)."""
        r = self.r
        size = int(min(9000, max(40, r.lognormvariate(6.3, 0.9))))
        if r.random() < 0.55:
            return self.prose(size if r.random() > 0.12 else 12), True
        text, _ = self.junk(max(size, 90))
        top = r.random()
        if top < 0.25:
            text = f"Table {r.randrange(99)}. {self.n().capitalize()}s in {r.choice(PLACES)}\n{text}"
        elif top < 0.4 and len(text) > 300:
            text = self.written() + r.choice(["\n", "\n\n"]) + text
        elif top < 0.5 and len(text) > 900:
            lead = self.prose(len(text) // 4)
            text = r.choice([lead + "\n\n" + text, text + "\n\n" + lead])
        return text, False


def labelled_documents(n: int = LABELLED, seed: int = 20240501) -> list[tuple[int, str, bool]]:
    """(id, text, is_prose), the same for the same n and seed."""
    m = Maker(seed)
    return [(i, *m.document()) for i in range(n)]
