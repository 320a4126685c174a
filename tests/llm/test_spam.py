import random

import numpy as np

from weftgraph.llm import spam as s

PROSE = "The quarry was founded in 1631 by the council, and it has been open to the public since then.\nAccording to the census the settlement had 375 inhabitants; most of them worked in the mill.\nThe river is crossed by an old bridge that was rebuilt after the fire of 1802.\n"
RNG = random.Random(4)


def keywords(n):
    return " ".join(RNG.choice(["cheap", "boots", "outlet", "online", "sale", "loans"]) for _ in range(n))


LISTS = {
    "keywords": keywords(150),
    "commas": ", ".join(keywords(3) for _ in range(50)),
    "places": " ".join(f"{RNG.choice(['cheap', 'best', 'buy'])} boots {''.join(RNG.choice('bdfgklmnprst') + RNG.choice('aeiou') for _ in range(4)).title()}" for _ in range(60)),
    "links": "\n".join(f"* [http://www.shop{i}.example/x cheap boots {i}]" for i in range(40)),
    "bare links": "<br>".join(f"https://m.shop{i}.example/p?id={i}" for i in range(40)),
    "anchors": " ".join(f'<a href="http://shop{i}.example/">cheap boots</a>' for i in range(40)),
    "hash tags": " ".join(f"#{RNG.choice(['cheap', 'buy'])}{RNG.choice(['boots', 'loans', 'tires'])}" for _ in range(80)),
    "products": "\n".join(f"Korda boots X{i} SKU-{i}77 €{i}.99 IN STOCK" for i in range(40)),
    "spelled out": " ".join(RNG.choice(["c.h.e.a.p", "b00ts", "s.a.l.e", "0utlet", "l0ans", "d.e.a.l"]) for _ in range(120)),
    "mock sentences": "For cheap boots click cheap boots. Our cheap boots is the best cheap boots. Buy cheap boots now. " * 12,
    "russian": "; ".join(RNG.choice(["купить дешево", "скидка цена", "заказать цена", "дешево скидка"]) for _ in range(70)),
}
FINE = {
    "prose": PROSE * 2,
    "navigation": "{{Navbox\n| list1 = " + " • ".join(f"[[Place {i}]]" for i in range(60)) + "\n}}",
    "facts": '{| class="wikitable"\n! Place !! Number !! Year\n' + "".join(f"|-\n| Town{i} || {i * 37 % 991} || {1900 + i}\n" for i in range(40)) + "|}",
    "glossary": "".join(f"; term{i}: the part of the mill that was used for the {i}th step of the work\n" for i in range(30)),
    "redirect": "#redirect [[Elsewhere]]",
    "smaller part": PROSE * 4 + keywords(60),
    "few links": PROSE * 2 + "== External links ==\n* [http://a.example/x page] \n* [http://b.example/y page]\n* [http://c.example/y page]\n",
    "vandalism": PROSE + "lol lol lol lol lol",
}


def test_pages(spark):
    cases = [(k, t) for k, t in [*LISTS.items(), *FINE.items()]]
    rows = [(i, t, "x") for i, (_, t) in enumerate(cases)] + [(100, None, ""), (101, "", ""), (102, " \n\t ", ""), (0, cases[0][1], "x"), (None, PROSE, ""), (103, PROSE * 3000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word_share string").repartition(3)
    got = {r.doc_id for r in s.spam_pages(df).collect()}
    assert {cases[i][0] for i in got} == set(LISTS)
    assert s.spam_pages(df.limit(0)).count() == 0


def fitted(pages, **how):
    return s.fit(s.observe(pages, s.Lines()), **how)


def shares_of(text, model):
    seen = s.observe([text], s.Lines(model.sales))
    _, words, chars = s.shares(seen, model.label(seen), 1)
    return words[0], chars[0]


def start_model():
    return s.Model(s.START, s.MOVE, s.starting_emissions())


def test_smaller_part_below_prose():
    page = PROSE * 4 + keywords(60)
    assert 0 < shares_of(page, fitted([page]))[0] < 0.5


def test_model_is_a_distribution():
    model = fitted([*LISTS.values(), *FINE.values()])
    assert np.allclose(model.emit[:, :, :-1].sum(2), 1) and np.allclose(model.move.sum(1), 1) and np.allclose(model.start.sum(), 1)


def test_label_against_exhaustive():
    from itertools import product

    model = start_model()
    seen = s.observe(["\n".join([PROSE.split("\n")[0], keywords(8), "[http://a.example/x boots]", "[[a]] [[b]]"]), keywords(5), PROSE], s.Lines())
    like = model.likelihood(seen.steps)
    for page in range(3):
        x = like[seen.page == page]
        score = lambda path: np.log(s.START[path[0]]) + sum(x[t, a] for t, a in enumerate(path)) + sum(np.log(s.MOVE[a, b]) for a, b in zip(path, path[1:]))  # noqa: E731,B023
        assert tuple(model.label(seen)[seen.page == page]) == max(product(range(4), repeat=len(x)), key=score)


def test_fit_against_plain_forward_backward():
    pages = [PROSE + keywords(90), "\n".join(LISTS["links"].split("\n")[:5]), "[[a]]", PROSE]
    seen = s.observe(pages, s.Lines())
    model = start_model()
    like = np.exp(model.likelihood(seen.steps))
    move = s.MOVE * s.PRIOR
    for page in range(len(pages)):
        x = like[seen.page == page]
        fore, rear = [s.START * x[0]], [np.ones(4)]
        for t in range(1, len(x)):
            fore.append((fore[-1] @ s.MOVE) * x[t])
            rear.insert(0, s.MOVE @ (x[-t] * rear[0]))
        for t in range(1, len(x)):
            move = move + s.MOVE * np.outer(fore[t - 1], x[t] * rear[t]) / fore[-1].sum()
    assert np.allclose(s.fit(seen, rounds=1).move, move / move.sum(1, keepdims=True))


def test_quantities_against_plain_counts():
    text = PROSE + keywords(95) + "\n* cheap\n" + keywords(41)
    lines = s.Lines()
    seen = s.observe(["x y", text, "", " "], lines)
    words = [[lines.words.text[w] for w in seen.word[seen.word_piece == i]] for i in range(len(seen.page))]
    mine = [i for i, p in enumerate(seen.page) if p == 1]
    every = [w for i in mine for w in words[i]]
    grid = s.GRID["same on page"]
    for i in mine:
        for pool, q in ((every, 5), (words[i], 6)):
            chance = np.mean([(pool.count(w) - 1) / (len(pool) - 1) for w in words[i]]) if words[i] and len(pool) > 1 else None
            unknown = chance is None or chance == 0 and len(words[i]) * (len(pool) - 1) < 256
            assert seen.steps[i, q] == (-1 if unknown else np.searchsorted(grid, chance, "right"))
    assert seen.words.sum() == len(s._WORD.findall(text)) + 2 and np.isclose(seen.chars[mine].sum(), sum(len(x) for x in text.split("\n")))
    assert max(len(w) for w in words) <= s.PIECE


def test_lines_are_read_alike_whatever_came_before(monkeypatch):
    pages = [*LISTS.values(), *FINE.values(), "價格 " * 9]
    once = s.observe(pages, s.Lines())
    monkeypatch.setattr(s, "LINE_CHARS", 100)
    lines = s.Lines()
    for page in range(len(pages)):
        seen = s.observe([pages[page]], lines)
        assert np.array_equal(seen.steps, once.steps[once.page == page])


def test_fit_decides():
    """Names that are no words of any kind, one a line: only the sample shows that such lines stand in lists."""
    def name():
        return "".join(RNG.choice("bdfgklmnprst") + RNG.choice("aeiou") for _ in range(3)).title()

    def page(n):
        return "\n".join(f"[http://{name()}.example/ {name()}]\n{name()} {name()} {name()}" for _ in range(n))

    sample = [page(20) for _ in range(60)] + [PROSE * 2] * 40
    text = "\n".join([f"{name()} {name()} {name()}\n" * 3 + f"[http://{name()}.example/]" for _ in range(12)])
    assert min(shares_of(text, start_model())) < 0.5
    assert min(shares_of(text, fitted(sample))) > 0.5
    assert max(shares_of(PROSE * 2, fitted(sample))) < 0.5


def test_sequence_decides():
    """The lines between keyword lists say nothing by themselves; those between paragraphs are the same."""
    model = fitted([*LISTS.values(), *FINE.values()] * 3)
    plain = ["Korda 12", "Velin 30", "Tamor 44"]
    listed = "\n".join(f"{keywords(12)}\n{x}\n{keywords(12)}" for x in plain * 4)
    told = "\n".join(f"{PROSE}{x}" for x in plain * 4)
    flat = s.Model(model.start, np.tile(model.start, (4, 1)), model.emit)

    def lists_of(text, m):
        seen = s.observe([text], s.Lines())
        few = np.array([len(x.split()) == 2 for x in text.split("\n") if x])
        return s.lists(m.label(seen))[few]

    assert lists_of(listed, model).all() and not lists_of(told, model).any()
    assert lists_of(listed, flat).all() == lists_of(told, flat).all()


def test_sales_words_help_short_pages(spark):
    long = [keywords(150) for _ in range(6)] + [PROSE * 2] * 60
    short = ["cheap boots Korda loans sale", "the mill and the quarry"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(long + short)], "doc_id long, text string")
    model = s.sample_model(df)
    assert {"cheap", "boots", "outlet"} <= model.sales and not {"quarry", "council"} & model.sales
    assert {r.doc_id for r in s.spam_pages(df).collect()} == {0, 1, 2, 3, 4, 5, 66}


def test_long_runs_end_soon():
    for t in ["1" * 100_000, "|" + " " * 100_000, "_" * 100_000, "a." * 50_000, "<a " * 50_000, "[[" * 50_000, "{{cite " * 50_000, "$" * 100_000, "http://" * 20_000, "#" * 100_000, "x" * 100_000, " " * 100_000, "-1" * 50_000]:
        seen = s.observe([t], s.Lines(frozenset({"x"})))
        assert len(seen.page) == len(seen.steps) == len(seen.chars) and np.isclose(seen.chars.sum(), 0 if t.isspace() else len(t))


def test_no_page_is_dropped_before_labelling(spark):
    def name(i):
        return "".join("bdfgklmnprst"[i // 12**k % 12] + "aeiou"[i // 5**k % 5] for k in range(4))

    pages = [
        "\n".join(" ".join(name(10 * line + k) for k in range(10) for _ in range(6)) for line in range(84)),  # repeats within lines only
        "\n".join(f"{name(3 * i)} {name(3 * i + 1)} SKU-{i} -20 % ☆ ✓" for i in range(60)),  # tags without a currency
        PROSE * 3,
    ]
    df = spark.createDataFrame(list(enumerate([*pages, " \n"])), "doc_id long, text string")
    shares = {r.doc_id: r for r in s.list_shares(df).collect()}
    assert set(shares) == {0, 1, 2}
    assert {r.doc_id for r in s.spam_pages(df).collect()} == {0, 1}


def test_sales_words_come_from_all_pages(spark):
    long = [" ".join(RNG.choice(["kaufen", "billig", "stiefel"]) for _ in range(150)) for _ in range(4)] + [PROSE * 2] * 60
    short = ["kaufen billig Korda stiefel", "the mill and the quarry"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(long + short)], "doc_id long, text string")
    assert s.sample_model(df, 2).sales == {"kaufen", "billig", "stiefel"}
    assert {r.doc_id for r in s.spam_pages(df, fit_pages=2).collect()} == {0, 1, 2, 3, 64}


def test_lists_in_scripts_without_spaces(spark):
    def joined(words, by, n=80):
        return by.join(RNG.choice(words) for _ in range(n))

    lists = [
        joined(["便宜", "手机", "特价", "购买"], "", 120),
        joined(["便宜", "手机", "特价", "购买"], "、", 120),
        joined(["激安", "通販", "バッグ", "時計"], "、"),
        joined(["ราคาถูก", "ซื้อรองเท้า", "ลดราคา"], ""),
        joined(["할인", "구매", "신발"], " ", 120),
        *(joined(["cheap", "boots", "outlet", "sale"], by, 150) for by in ("/", "|", ",")),
    ]
    fine = [
        "这座桥建于一六三一年，是当地居民为了方便过河而修建的。十九世纪的一场大火烧毁了旧城的大部分房屋，市议会随后决定重建。如今博物馆收藏着当时的地图与书信，每年吸引许多游客前来参观。",
        "この橋は江戸時代に建てられ、火災の後に再建された。町の人口は約三千人で、多くの住民が製粉所で働いていた。現在は博物館として公開されており、古い地図や手紙が展示されている。",
        "สะพานแห่งนี้สร้างขึ้นในสมัยโบราณและได้รับการบูรณะหลังเกิดเพลิงไหม้ครั้งใหญ่ ปัจจุบันเป็นพิพิธภัณฑ์ที่เปิดให้ประชาชนเข้าชม มีแผนที่เก่าและจดหมายจัดแสดงอยู่มากมาย",
        PROSE * 3,
    ]
    df = spark.createDataFrame(list(enumerate([*lists, *fine])), "doc_id long, text string")
    assert {r.doc_id for r in s.spam_pages(df).collect()} == set(range(len(lists)))
