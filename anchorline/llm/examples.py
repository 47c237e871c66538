"""Labelled example documents for the rules that tell prose from lists, tables and junk; all invented here, from a seed."""

from __future__ import annotations

import base64
import random
import textwrap

#: Sentences are a subject, a predicate and an optional phrase; items are what lists and tables hold. One line a language.
SUBJECTS = {
    "en": "the baker|our teacher|a tired nurse|the little dog|my aunt|everyone in the house|the captain of the boat|this engineer|their cousin|the woman from the market",
    "de": "der Bäcker|unsere Lehrerin|ein müder Pfleger|der kleine Hund|meine Tante|jeder im Haus|die Kapitänin|dieser Ingenieur|ihr Vetter|die Frau vom Markt",
    "fr": "le boulanger|notre professeur|une infirmière fatiguée|le petit chien|ma tante|tout le monde à la maison|la capitaine du bateau|cet ingénieur|leur cousin|la femme du marché",
    "es": "el panadero|nuestra maestra|un enfermero cansado|el perro pequeño|mi tía|toda la gente de la casa|la capitana del barco|este ingeniero|su primo|la mujer del mercado",
    "ru": "пекарь|наша учительница|усталая медсестра|маленькая собака|моя тётя|каждый в этом доме|капитан корабля|этот инженер|их двоюродный брат|женщина с рынка",
    "ja": "パン屋さんは|私たちの先生は|疲れた看護師は|小さな犬は|叔母は|家の人はみんな|船の船長は|その技師は|彼らのいとこは|市場の女の人は",
}
PREDICATES = {
    "en": "walks to the river and looks at the boats|has lost the key of the garden|is waiting for a letter from the city|wants to know what it will cost|gives 14 of the apples to the children|does not like the colour of the wall|will be here before the end of the week|said that there was no time for that|bought 238 bricks for the new school|sings",
    "de": "geht an den Fluss und sieht sich die Boote an|hat den Schlüssel zum Garten verloren|wartet auf einen Brief aus der Stadt|will wissen, was es kosten wird|gibt den Kindern 14 von den Äpfeln|mag die Farbe der Wand nicht|wird vor dem Ende der Woche hier sein|sagte, dass dafür keine Zeit war|hat 238 Ziegel für die neue Schule gekauft|singt",
    "fr": "marche jusqu'à la rivière et regarde les bateaux|a perdu la clé du jardin|attend une lettre de la ville|veut savoir ce que cela va coûter|donne 14 des pommes aux enfants|n'aime pas la couleur du mur|sera ici avant la fin de la semaine|a dit qu'il n'y avait pas le temps pour ça|a acheté 238 briques pour la nouvelle école|chante",
    "es": "camina hasta el río y mira los barcos|ha perdido la llave del jardín|espera una carta de la ciudad|quiere saber lo que va a costar|da 14 de las manzanas a los niños|no le gusta el color de la pared|estará aquí antes del fin de la semana|dijo que no había tiempo para eso|compró 238 ladrillos para la nueva escuela|canta",
    "ru": "идёт к реке и смотрит на лодки|не может найти ключ от сада|ждёт письма из города|хочет знать, сколько это будет стоить|даёт детям 14 яблок|не любит цвет этой стены|будет здесь до конца недели|говорит, что на это не было времени|везёт 238 кирпичей для новой школы|поёт",
    "ja": "川まで歩いて船を見ています|庭の鍵をなくしました|町からの手紙を待っています|それがいくらかかるかを知りたがっています|子供たちにりんごを14個あげます|壁の色が好きではありません|週の終わりまでにここに来ます|そのための時間はないと言いました|新しい学校のためにれんがを238個買いました|歌います",
}
PHRASES = {
    "en": "in the evening|because of the rain|with a smile on the face|when the sun comes up|for the second time this year|without a word to the others|although it is still dark",
    "de": "am Abend|wegen des Regens|mit einem Lächeln im Gesicht|wenn die Sonne aufgeht|zum zweiten Mal in diesem Jahr|ohne ein Wort zu den anderen|obwohl es noch dunkel ist",
    "fr": "le soir|à cause de la pluie|avec un sourire sur le visage|quand le soleil se lève|pour la deuxième fois cette année|sans un mot aux autres|même s'il fait encore nuit",
    "es": "por la tarde|a causa de la lluvia|con una sonrisa en la cara|cuando sale el sol|por segunda vez este año|sin una palabra a los otros|aunque todavía está oscuro",
    "ru": "по вечерам|из-за дождя|с улыбкой на лице|когда встаёт солнце|во второй раз за этот год|без слов для других|хотя ещё темно",
    "ja": "夕方に|雨のために|笑顔で|日が昇るときに|今年で二度目に|ほかの人に何も言わずに|まだ暗いのに",
}
ITEMS = {
    "en": "blue paint|soap|two onions|bread knife|wooden spoon|salt|cheese, 300 g|bag of rice|towels|matches|winter boots|toothbrush|hammer|glue|milk|box of screws|plant pot|coffee filters|umbrella|cup",
    "de": "blaue Farbe|Seife|zwei Zwiebeln|Brotmesser|Holzlöffel|Salz|Käse, 300 g|Sack Reis|Handtücher|Streichhölzer|Winterstiefel|Zahnbürste|Hammer|Leim|Milch|Kiste Schrauben|Blumentopf|Kaffeefilter|Regenschirm|Tasse",
    "fr": "peinture bleue|savon|deux oignons|couteau à pain|cuillère en bois|sel|fromage, 300 g|sac de riz|serviettes|allumettes|bottes d'hiver|brosse à dents|marteau|colle|lait|boîte de vis|pot de fleurs|filtres à café|parapluie|tasse",
    "es": "pintura azul|jabón|dos cebollas|cuchillo de pan|cuchara de madera|sal|queso, 300 g|saco de arroz|toallas|cerillas|botas de invierno|cepillo de dientes|martillo|pegamento|leche|caja de tornillos|maceta|filtros de café|paraguas|taza",
    "ru": "синяя краска|мыло|две луковицы|хлебный нож|деревянная ложка|соль|сыр, 300 г|мешок риса|полотенца|спички|зимние сапоги|зубная щётка|молоток|клей|молоко|коробка винтов|цветочный горшок|кофейные фильтры|зонт|чашка",
    "ja": "青いペンキ|石けん|玉ねぎ|パン切り包丁|木のスプーン|塩|チーズ 300 g|米の袋|タオル|マッチ|冬のブーツ|歯ブラシ|金づち|のり|牛乳|ねじの箱|植木鉢|コーヒーフィルター|傘|茶わん",
}
HEADINGS = {
    "en": "Things to get|For the kitchen|Inventory|Box four", "de": "Zu besorgen|Für die Küche|Bestand|Kiste vier", "fr": "Choses à prendre|Pour la cuisine|Inventaire|Caisse quatre",
    "es": "Cosas que traer|Para la cocina|Inventario|Caja cuatro", "ru": "Что взять|Для кухни|Опись|Ящик четыре", "ja": "買うもの|台所用|在庫|箱四",
}
COLUMNS = {
    "en": "Name|Pieces|Cost|Town|Day", "de": "Name|Stück|Kosten|Stadt|Tag", "fr": "Nom|Pièces|Coût|Ville|Jour", "es": "Nombre|Piezas|Coste|Ciudad|Día", "ru": "Название|Штук|Цена|Город|День", "ja": "名前|個数|値段|町|日",
}
#: Somebody says something, and something about a person: {0} and {1} are names, {2} a number.
SAYINGS = {
    "en": '"Nobody knows that," {0} says.|"It was not me!" {0} cries.|{0} comes from {1} and earns {2}.80 a month.|"{0}?" {1} asks.|There were {2} people in {0} today.|Who has seen {0}?',
    "de": '„Das weiß niemand“, sagt {0}.|„Ich war es nicht!“, ruft {0}.|{0} kommt aus {1} und verdient {2},80 im Monat.|Heute waren {2} Leute in {0}.|Wer hat {0} gesehen?',
    "fr": "« Personne ne le sait », dit {0}.|— Ce n'était pas moi, crie {0}.|{0} vient de {1} et gagne {2},80 par mois.|Il y avait {2} personnes à {0} aujourd'hui.|Qui a vu {0} ?",
    "es": "—Nadie lo sabe —dijo {0}.|—¡No fui yo! —grita {0}.|{0} viene de {1} y gana {2},80 al mes.|Hoy había {2} personas en {0}.|¿Quién ha visto a {0}?",
    "ru": "— Никто этого не знает, — сказал {0}.|— Это был не я! — кричит {0}.|{0} приехал из города {1} и получает {2},80 в месяц.|Сегодня в городе {0} было {2} человек.|Кто видел {0}?",
    "ja": "「だれも知りません」と{0}は言います。|「私ではありません」と{0}は叫びます。|{0}は{1}から来て、月に{2}.80を稼ぎます。|今日は{0}に{2}人がいました。|だれが{0}を見ましたか。",
}
LANGS = list(SUBJECTS)


def _pick(r: random.Random, table: dict[str, str], lang: str) -> str:
    return r.choice(table[lang].split("|"))


def _name(r: random.Random) -> str:
    return "".join(r.choice("bcdfghklmnprstv") + r.choice("aeiou") + r.choice(["", "n", "r", "l", "s"]) for _ in range(r.randint(2, 3))).capitalize()


def _sentence(r: random.Random, lang: str) -> str:
    if r.random() < 0.2:
        return _pick(r, SAYINGS, lang).format(_name(r), _name(r), r.randint(2, 999))
    s, p, f = (_pick(r, t, lang) for t in (SUBJECTS, PREDICATES, PHRASES))
    if r.random() < 0.1:
        s = _name(r) + ("は" if lang == "ja" else "")
    if lang == "ja":
        return (f + "、" if r.random() < 0.4 else "") + s + p + r.choice("。。。！")
    form = r.random()
    text = f"{s} {p}" if form < 0.4 else f"{f}, {s} {p}" if form < 0.6 else f"{s} {p} {f}" if form < 0.85 else f"{s} {p}, {f}"
    mark = r.choice("......!?")
    return text[0].upper() + text[1:] + mark


def prose(r: random.Random, lang: str) -> str:
    """Whole or cut short, with or without marks, in capitals, line by line or wrapped."""
    n = r.choice([1, 1, 1, 1, 2, 3, 4, 6, 9, 14, 40])
    parts = [_sentence(r, lang) for _ in range(n)]
    join = "" if lang == "ja" else " "
    if n > 1 and r.random() < 0.3:
        join = r.choice(["\n", "\n\n", "\r\n"])
    text = join.join(parts)
    if n > 2 and r.random() < 0.25:  # paragraphs
        k = r.randint(1, 4)
        glue = "" if lang == "ja" else " "
        text = r.choice(["\n", "\n\n", "\r\n"]).join(glue.join(parts[i : i + k]) for i in range(0, n, k))
    form = r.random()
    if form < 0.14:
        text = text[: r.randint(min(8, len(text)), len(text))]
    elif form < 0.2:
        text = text.upper()
    elif form < 0.3:
        text = "".join(c for c in text.lower() if c not in '.!?"。！')
    elif form < 0.45 and n > 1:
        width = r.choice([24, 36, 48, 60, 72])
        flat = "".join(parts) if lang == "ja" else " ".join(parts)
        text = "\n".join(flat[i : i + width // 2] for i in range(0, len(flat), width // 2)) if lang == "ja" else textwrap.fill(flat, width)
    elif form < 0.5:
        text = text.replace(" ", " ", r.randint(1, 5)) if lang != "ja" else "　" + text
    elif form < 0.54:
        text += r.choice([" 🙂", " (!)", " №7", " :)", " …", " [1]", " {1}", " a=2"])
    elif form < 0.57:
        text = text.replace(" ", r.choice(["  ", " \t", "   "]), r.randint(1, 6))
    return text


def listing(r: random.Random, lang: str) -> str:
    """One item a line or all in a row, with or without heading, marks and counts."""
    items = r.sample(ITEMS[lang].split("|"), r.randint(4, 15))
    count = r.random() < 0.4
    items = [f"{x} x{r.randint(1, 250)}" if count else x for x in items]
    head = _pick(r, HEADINGS, lang) if r.random() < 0.5 else ""
    if r.random() < 0.25:
        sep = r.choice(["; ", ", ", " / ", " | ", " • ", " · ", " + "])
        if sep == ", ":
            items = [x.replace(",", "") for x in items]
        return (head + ": " if head else "") + sep.join(items) + r.choice(["", "", "."])
    end = r.choice(["", "", "", ",", ";", "."])
    mark = r.choice(["- ", "* ", "• ", "– ", "+ ", "[ ] ", "1. ", "1) ", "a) ", "a. ", "", "", "> "])
    out = []
    for i, x in enumerate(items):
        m = mark.replace("1", str(i + 1)).replace("a", chr(97 + i)) if mark[:1] in "1a" and mark else mark
        out.append(m + x + end)
    return "\n".join(([head + r.choice(["", ":"])] if head else []) + out)


def table(r: random.Random, lang: str) -> str:
    """Rows of cells, delimited or aligned, with or without header and rules."""
    width, n = r.randint(3, 5), r.randint(3, 14)
    cells = [[_pick(r, ITEMS, lang).replace(",", ""), str(r.randint(1, 900)), f"{r.uniform(1, 999):.2f}", _name(r), f"D{r.randint(1, 31):02d}"][:width] for _ in range(n)]
    if r.random() < 0.6:
        cells.insert(0, COLUMNS[lang].split("|")[:width])
    form = r.choice(["\t", ",", ";", "|", "space", "space"])
    if form == "space":
        sizes = [max(len(row[j]) for row in cells) for j in range(width)]
        lines = ["  ".join(c.ljust(s) for c, s in zip(row, sizes, strict=True)).rstrip() for row in cells]
        rule = "-+-".join("-" * s for s in sizes)
        if r.random() < 0.3:
            lines.insert(r.choice([0, 1]), rule)
        return "\n".join(lines)
    if form == "|":
        lines = ["| " + " | ".join(row) + " |" if r.random() < 2 else "" for row in cells]
        if r.random() < 0.4:
            lines.insert(1, "|" + "---|" * width)
        return "\n".join(lines)
    return "\n".join(form.join(row) for row in cells)


def junk(r: random.Random, lang: str) -> str:
    """Noise, debris of files and pages, or one scrap over and over."""
    form = r.randrange(11)
    n = r.randint(40, 500)
    if form == 0:
        data = base64.b64encode(r.randbytes(n)).decode()
        return "\n".join(textwrap.wrap(data, 76)) if r.random() < 0.7 else data
    if form == 1:
        return r.randbytes(n).hex()
    if form == 2:
        text = "".join(prose(r, lang) for _ in range(2))[: r.randint(40, 200)]
        return "".join(r.choice("�□¤~¿?#") if c != " " and r.random() < r.uniform(0.35, 0.8) else c for c in text)
    if form == 3:
        return " ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(r.randint(4, 14))) for _ in range(r.randint(6, 60)))
    if form == 4:
        return "".join(r.choice("!$%&*<>=?@[]\\_{}|~^+- ") for _ in range(r.randint(20, 200)))
    if form == 5:
        bits = ['<div class="c%d">', "</td><td>", "<br/>", "&nbsp;&nbsp;", "&nbsp;", "{padding:%dpx}", "function(){var b%d=1;}", "(); let v%d=2;", "</span>", "<li><a href='#%d'>", "&amp;", "Home | About | ", "});", "item(%d);"]
        bits = r.sample(bits, r.randint(3, 8))
        return "".join(b % r.randint(1, 99) if "%d" in b else b for b in r.choices(bits, k=r.randint(10, 60)))
    if form == 6:
        return r.choice("zqxeaomst-_=*.#") * r.randint(40, 300)
    if form in (7, 8):
        scrap = _pick(r, ITEMS, lang) + " " + _pick(r, PHRASES, lang) + r.choice([" ", " >> ", " | ", "\n", " - "])
        return (scrap * r.randint(8, 40))[: r.randint(len(scrap) * 6, len(scrap) * 40)]
    if form == 9:
        return " ".join(str(r.randrange(10 ** r.randint(1, 9))) for _ in range(r.randint(15, 120)))
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))


def labelled(seed: int, each: int = 900) -> list[tuple[str, str]]:
    """(text, kind): three times as many of prose as of each other kind, in all languages."""
    r = random.Random(seed)
    out = []
    for kind, make, n in (("prose", prose, 3 * each), ("list", listing, each), ("table", table, each), ("junk", junk, each)):
        out += [(make(r, LANGS[i % len(LANGS)]), kind) for i in range(n)]
    r.shuffle(out)
    return out
