"""Operators that judge texts one by one: against plain versions and held-out labels."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from cohortveil.llm import decontaminate, language, pieces, quality_model, quality_rules, secrets

SENTENCE = "the cat sat on the mat and looked at the dog over there "
EMPTY = "doc_id long, text string, lang string, source string"


def plain_contamination(docs, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for k, t in items:
        w = words(t)
        for i in range(max(len(w) - window + 1, 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(k)
    sizes = {len(x) for x in windows}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if k := windows.get(tuple(w[i : i + size])):
                    hit.update(range(i, i + size))
                    found |= k
        out.append((d, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block", [10**6, 40])
def test_contamination_matches_plain(spark, block):
    r = random.Random(5)
    draw = lambda n: " ".join(r.choice(["the", "a", "Of", "in", "é1", "x"]) for _ in range(n))
    items = [(str(k), draw(r.choice([1, 5, 13, 20, 40]) if k else 30)) for k in range(9)] + [("9", None), ("10", ""), ("11", "...")]
    docs = [(i, "-".join([draw(r.randrange(30)), r.choice(items)[1] or "", draw(r.randrange(30)) + "?!"])) for i in range(80)] + [(98, None), (99, "")]
    found = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), block_words=block)
    assert sorted(tuple(x) for x in found.collect()) == sorted(plain_contamination(docs, items))
    none = spark.createDataFrame([], "item_id string, text string")
    assert not decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), none).where("n_hit > 0").count()


def test_contaminated_words_are_cut():
    assert decontaminate.cut(b"One, two three! four", [(1, 3)]) == "One, ! four"


def test_blocks_of_items_are_held_one_at_a_time(spark, monkeypatch):
    sc, held, most = spark.sparkContext, [], []
    plain = type(sc).broadcast

    def broadcast(self, value):
        out = plain(self, value)
        held.append(out)
        most.append(len(held))
        free = out.destroy
        out.destroy = lambda *a: (held.remove(out), free(*a))
        return out

    monkeypatch.setattr(type(sc), "broadcast", broadcast)
    items = [(str(k), " ".join(f"w{k}x{i}" for i in range(20))) for k in range(4)]
    docs = [(1, items[0][1] + " and " + items[3][1]), (None, items[2][1]), (None, items[2][1]), (4, "none"), (5, None)]
    rows = spark.createDataFrame([(*x, k) for k, x in enumerate(docs)], "doc_id long, text string, row int")
    out = decontaminate.decontaminate(rows, spark.createDataFrame(items, "item_id string, text string"), block_words=20, with_text=True, carry=("row",))
    got = sorted((tuple(r) for r in out.collect()), key=lambda r: r[-1])
    assert got == [(1, 41, 40, ["0", "3"], True, "and", 0), *((None, 20, 20, ["2"], True, "", k) for k in (1, 2)), (4, 1, 0, [], False, "none", 3), (5, 0, 0, [], False, "", 4)]
    assert most == [1] * 4


def test_secrets(spark):
    key = "AKIA" + "A1B2" * 4
    text = f'é password = "Zx9+qL2/vT"; token: short; {key} and {"0123456789abcdef" * 3}. pwd: Tr0ub4dor&3xK9qZw pass: password123'
    rows = spark.createDataFrame([(1, text), (2, None), (3, "secret: abc token = secret: abcdefghijk"), (None, text)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.scan_secrets(rows, with_text=True).collect()}
    assert (got[1]["n_assign"], got[1]["n_access"], got[1]["n_hex"], got[1]["n_guess"]) == (1, 1, 1, 1)
    assert got[1]["spans"] == got[None]["spans"] and got[1]["spans"].startswith("assign:2:24,")
    assert "Tr0ub" not in got[1]["clean_text"] and "password123" in got[1]["clean_text"]
    assert got[2]["spans"] == "" and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[3]["n_assign"] == 0


def test_long_credentials_are_masked_whole(spark):
    key = "".join(random.Random(4).choices("ABCXYZabcxyz0189+/", k=300))
    rows = spark.createDataFrame([(1, f"private_key: {key} end"), (2, f"bearer = {key * 40}")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.scan_secrets(rows, with_text=True).collect()}
    assert got[1]["spans"] == "guess:13:313" and got[1]["clean_text"] == "private_key: [SECRET] end"
    assert got[2]["spans"] == "guess:9:12009" and got[2]["clean_text"] == "bearer = [SECRET]"


def test_every_credential_context_is_judged(spark):
    hard = ["k$9!vQ@2#mZx7", "Tr0ub4dor&3xK9qZw", "xKqZvbTmWpLrYn", "4,7;1|9<2>8'55$1", "q7$Zk!"]
    names = ["password", "PASSWD", "secret", "token", "api_key", "apikey", "pass", "DB_PWD", "smtp_pass", "aws_secret_access_key"]
    texts = [f"{n}{sep}{q}{v}{q}. and" for n in names for sep in ("=", ": ") for q in ("", '"') for v in hard]
    texts += ["token = secret: k$9!vQ@2#mZx7, and", '{"user_token":"Tr0ub4dor&3xK9qZw","pass":"k$9!vQ@2#mZx7","x":"and"}', "pin: AKIA" + "A1B2" * 4 + "$zQ9 and"]
    weak = ["password: password123 and", "login: 1987-06-12, and", 'token="monkey" pass: and']
    rows = spark.createDataFrame(list(enumerate(texts + weak)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.scan_secrets(rows, with_text=True).collect()}
    for k, text in enumerate(texts):
        clean = got[k]["clean_text"]
        assert "[SECRET]" in clean and "and" in clean and not any(v[-4:] in clean or v[:4] in clean for v in [*hard, "$zQ9", "A1B2"]), text
        base = secrets.base_spans(text)
        assert got[k]["n_assign"] == sum(s[1] == 0 for s in base) and got[k]["base_sha256"] == hashlib.sha256(secrets.joined(base).encode()).hexdigest()
    assert [got[len(texts) + k]["clean_text"] for k in range(len(weak))] == ["[SECRET] and", *weak[1:]]


def plain_cost(value, ranks):
    """The least cost over all ways to cut the value up."""
    brute = math.log10(secrets.alphabet(value))
    date = r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)\d\d"

    def one(part):
        low, costs = part.lower(), [len(part) * brute]
        leet = low.translate(secrets.LEET)
        rank = ranks.get(low) or ranks.get(leet)
        if len(part) >= 3 and rank:
            costs.append(math.log10(rank + 1) + 0.3 * (1 + (part != low) + (low != leet)))
        if len(part) >= 3 and all(pair in secrets.NEAR for pair in zip(low, low[1:])):
            costs.append(math.log10(40 * len(part)) + 0.3)
        if len(part) >= 3:
            costs += [size * brute + math.log10(len(part) // size) + 0.3 for size in range(1, len(part) // 2 + 1) if part == part[:size] * (len(part) // size)]
        if re.fullmatch(date, part):
            costs.append(math.log10(365 * 130))
        if re.fullmatch(r"(?:19|20)\d\d", part):
            costs.append(math.log10(130))
        return min(costs)

    if not value:
        return 0.0
    return min(one(value[:k]) + plain_cost_rest(value[k:], one) for k in range(1, len(value) + 1))


def plain_cost_rest(rest, one):
    return min((one(rest[:k]) + plain_cost_rest(rest[k:], one) for k in range(1, len(rest) + 1)), default=0.0)


def test_guess_cost_is_the_least_of_all_cuts():
    r = random.Random(11)
    ranks = secrets.ranked(["sunflower", "era"])
    pool = ["19", "99", "1231", "2001", "qwe", "pass", "P@ss", "aa", "ab", "era", "12", "-", "x", "7"]
    values = ["".join(r.choice(pool) for _ in range(r.randrange(6)))[:11] for _ in range(120)] + ["1219991231", "abababab", "qwqwqwer"]
    for v in values:
        assert secrets.guess_cost(v, ranks) == pytest.approx(plain_cost(v, ranks)), v
    assert secrets.guess_cost("1219991231") < 6.7 and secrets.guess_cost("sunflower", ranks) < 3 < 10 < secrets.guess_cost("sunflower")


def test_long_values_cost_what_they_are_made_of():
    r = random.Random(12)
    odd = "".join(r.choice("bcdfghjkmnpqrstvwxz") for _ in range(2000))
    assert secrets.guess_cost(odd, enough=10.0) >= 10 and secrets.guess_cost(odd) > 2000
    assert secrets.guess_cost("ab" * 100) < 6 and secrets.guess_cost("x" * 5000, enough=10.0) < 6
    for size in (256, 512, 800, 900, 5000, 200_000):
        assert secrets.guess_cost("-" * size, enough=10.0) == pytest.approx(math.log10(33) + math.log10(size) + 0.3)
    assert secrets.guess_cost("sdfdsasd" * 4000, enough=10.0) < 6.5 and secrets.guess_cost("qwe" * 900 + "monkey", enough=10.0) < 10
    text = f"password: {'*' * 900} password: {'*' * 200}"
    assert secrets.guessed_spans(text, secrets.base_spans(text)) == []
    assert secrets.guess_cost(odd[:300]) >= secrets.guess_cost(odd[:200]) and secrets.guess_cost("\u0130stanbul") > 0


def test_the_corpus_is_the_dictionary(spark):
    rows = [(k, "the wonderful sunflowerfield " + "pass: sunflowerfield end" * (k == 0)) for k in range(60)] + [(None, None), (70, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert secrets.corpus_words(docs) == ["sunflowerfield", "the", "wonderful"] and secrets.corpus_words(docs, 1) == ["sunflowerfield"]
    assert {r["n_guess"] for r in secrets.scan_secrets(docs).collect()} == {0}
    assert [r["n_guess"] for r in secrets.scan_secrets(docs.where("doc_id = 0")).collect()] == [1]


def test_base_spans_follow_the_contract():
    r = random.Random(13)
    pool = ["password", "Token", "api_key", "APIKEY", "secret", "passwd", '"', "'", " ", ":", "=", "AKIA", "A1B2C3D4", "0123456789abcdef", "ffff0000", "x", "\n", "é", "-/+", "."]
    kinds = (r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", "AKIA[A-Z0-9]+", "[0-9a-f]+")
    least = (8, 16, 32)
    for _ in range(3000):
        text = "".join(r.choice(pool) for _ in range(r.randrange(14)))
        want = sorted((m.start(), k, m.end()) for k, p in enumerate(kinds) for m in re.finditer(p, text) if len(m[2] if k == 0 else m[0]) >= least[k])
        assert secrets.base_spans(text) == want, text


def test_guess_costs():
    cost = secrets.guess_cost
    assert cost("") == 0 and cost("password") < 3 and cost("qwertyuiop") < 4 and cost("1987-06-12") < 6 and cost("abcabcabcabc") < 6
    assert cost("xK9#qLw2Vz") > 15 and cost("P@ssw0rd") < 4 and cost("x" * 500) < 60


def test_pieces_match_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    public = pytest.importorskip("public_tokenizers")
    model = public.path("piece_bpe_32k.model")
    processor = sentencepiece.SentencePieceProcessor(model_file=model)
    r = random.Random(3)
    texts = ["".join(r.choice(["the ", "  ", "▁", "\n", "tion", "é", "梦", "😀", "a", ".", ",", "9"]) for _ in range(r.randrange(80))) for _ in range(150)] + ["", None, " ", "\n\n", "a" * 300, "ab" * 2000, "word, word. word"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in pieces.encode_pieces(rows, model, with_ids=True).collect()}
    for k, text in enumerate(texts):
        ids = processor.encode(text or "")
        assert got[k]["ids"] == ids and got[k]["n_tokens"] == len(ids) and got[k]["decoded"] == processor.decode(ids) and got[k]["n_corrected"] == 0
        assert got[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    vocabulary = pieces.Vocabulary(processor)
    units = ["▁inter", "national", "▁▁▁x", "zzzz"]
    assert vocabulary.encode_units(units) == [vocabulary.agenda(u) for u in units]


def plain_rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    repeated = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\f\r")]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


@pytest.mark.parametrize("bits", [24, 3])
def test_quality_counts_and_outliers(spark, monkeypatch, bits):
    monkeypatch.setattr(quality_rules, "INDEX_BITS", bits)
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghé") for _ in range(r.randrange(3, 8)))
    clean = [" ".join(word() for _ in range(120)) for _ in range(90)]
    junk = [" ".join(word() + r.choice("#*$%") * 3 for _ in range(90)) for _ in range(6)]
    odd = [None, "", " \n", "a b c a b c", "x\x0by z\n\nx\x0by z\n \n" * 3, "a " * 200, "a b c d " * 20]
    texts = clean + junk + odd
    rows = spark.createDataFrame([(k, t, "en" if k % 3 else None, "hot", k) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, x0 int")
    got = {x["doc_id"]: x for x in quality_rules.judge(rows).collect()}
    for k, t in enumerate(texts):
        counts = plain_rules(t)
        assert tuple(got[k])[1:6] == counts
        assert got[k]["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
    assert all(got[k]["kept"] for k in range(90)) and not any(got[k]["kept"] for k in range(90, len(texts)))
    assert quality_rules.judge(spark.createDataFrame([], EMPTY)).collect() == []


def plain_estimate(x, granted, core=0.75):
    """Concentration steps from three starts to the least determinant."""
    middle = np.median(x, 0)
    mad = 1.4826 * np.median(abs(x - middle), 0)
    reach = 2 * np.sqrt(mad**2 + np.diag(granted))
    drawn = np.clip(x, middle - reach, middle + reach)
    found = []
    for centre, scatter in ((middle, np.diag(mad**2)), (x.mean(0), np.cov(x.T, bias=True)), (drawn.mean(0), np.cov(drawn.T, bias=True))):
        scatter = scatter + granted
        det = np.linalg.det(scatter)
        while True:
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(scatter), x - centre)
            near = x[d <= np.sort(d)[int(np.ceil(core * len(d))) - 1]]
            new = near.mean(0), quality_rules.consistency(core) * np.cov(near.T, bias=True) + granted
            found.append((np.linalg.det(scatter), centre, scatter))
            if np.linalg.det(new[1]) >= det * (1 - quality_rules.FALL):
                found.append((np.linalg.det(new[1]), *new))
                break
            (centre, scatter), det = new, np.linalg.det(new[1])
    return min(found, key=lambda f: f[0])


def test_robust_estimate_matches_numpy(spark):
    r = np.random.default_rng(2)
    far = np.concatenate((r.normal(size=(300, 4)) @ np.diag([1, 2, 0.5, 1]), r.normal(30, 1, (60, 4))))
    turned = np.concatenate((r.normal(size=(200, 4)) @ r.normal(size=(4, 4)), r.normal(size=(60, 4)) + np.array([4, -4, 4, 0])))
    groups = {1: far, 2: turned, 3: np.repeat(r.normal(size=(1, 4)), 50, 0)}
    rows = spark.createDataFrame([(*map(float, v), g) for g, x in groups.items() for v in x], "x0 double, x1 double, x2 double, x3 double, g int").selectExpr("struct(g) AS group", "x0", "x1", "x2", "x3")
    granted = np.diag(np.array(quality_rules.GRANTED) ** 2)
    rows = spark.createDataFrame(quality_rules.salted(rows).collect(), quality_rules.salted(rows).schema)
    found = quality_rules.measured(rows, quality_rules.estimates(rows)).collect()
    for g, x in groups.items():
        _, centre, scatter = plain_estimate(x, granted)
        d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(scatter), x - centre)
        assert np.allclose(sorted(y["d2"] for y in found if y["group"]["g"] == g), sorted(d), rtol=0.05, atol=1e-6)
    assert min(y["d2"] for y in found if y["group"]["g"] == 1 and y["x0"] > 20) > quality_rules.LIMIT


def test_bundles_match_plain_vectors():
    profiles = language.Profiles(64, 3)
    text = "Ab, ab! déjà vu " * 40 + "".join(chr(0x4E00 + k) for k in range(3000)) + "\U00020000x"
    codes, counts = profiles.grams(text)
    plain = np.zeros(64)
    letters = [0] + [ord(c) if c.isalpha() else 0 for c in text.lower()] + [0]
    letters = [c for k, c in enumerate(letters) if k == 0 or c or letters[k - 1]]
    for k in range(len(letters) - 2):
        plain += profiles.letter(letters[k + 2]) * np.roll(profiles.letter(letters[k + 1]), 1) * np.roll(profiles.letter(letters[k]), 2)
    assert counts.sum() == len(letters) - 2 and len(codes) > 2 * language.CHUNK and np.allclose(profiles.bundle(codes, counts), plain)


def test_language_ties_repeats_and_clashes(spark):
    rows = [(1, "same words here", "b", 0.5), (2, "same words here", "a", 0.5), (2, "same words here", "a", 0.5), (None, "same words here", None, 0.1), (7, "", "b", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = language.identify(docs).collect()
    assert len(got) == 5 and {x["lang_pred"] for x in got} == {"a", "und"}


def test_language_held_out(spark):
    r = random.Random(6)
    pools = {"en": ["the", "with", "thing", "over", "house", "water"], "de": ["über", "nicht", "schön", "haus", "wasser", "zwischen"], "fr": ["où", "être", "maison", "château", "nous", "avec"]}
    rows = [(k, " ".join(r.choice(pools[lang]) for _ in range(20)), lang) for k in range(300) for lang in [r.choice(list(pools))]]
    rows += [(900, None, "en"), (901, "123 ...", "de"), (None, "the house", None)]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    found = {x["doc_id"]: x for x in got}
    assert len(got) == len(rows) and found[900]["lang_pred"] == found[901]["lang_pred"] == "und" and found[900]["score"] == 0
    held = [(d, lang) for d, _, lang in rows if d is not None and d < 900 and found[d]["held_out"]]
    assert len(held) > 30 and np.mean([found[d]["lang_pred"] == lang for d, lang in held]) > 0.95
    assert language.identify(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


def test_quality_model_held_out(spark):
    r = random.Random(8)
    good = lambda: SENTENCE * r.randrange(1, 4) + "".join(r.choice("abcdef ") for _ in range(60)) + "."
    bad = lambda: " ".join(r.choice(["BUY!!", "NOW!!", "###", "win$$$"]) for _ in range(30))
    rows = [(k, good() if k % 3 else bad()) for k in range(400)] + [(990, None), (991, ""), (None, good())]
    labels = [(k, int(k % 3 > 0), 0) for k in range(400)] + [(0, None, 0), (None, 1, 0)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in quality_model.classify(docs, marks).collect()}
    held = [k for k in range(400) if got[k]["held_out"]]
    assert len(held) > 80 and np.mean([got[k]["predicted"] == (k % 3 > 0) for k in held]) > 0.97
    assert 0 <= got[990]["score"] <= 1 and got[990]["score"] == got[991]["score"]
    assert {x["score"] for x in quality_model.classify(docs, marks.limit(0)).collect()} == {0.5}


def test_stretches_lose_no_cheapest_way():
    """Values of few letters, with repeats inside repeats and walks, against all cuts; a limit never changes what is below it."""
    r, ranks = random.Random(21), secrets.ranked(["aab", "sas"])
    for _ in range(120):
        v = "".join(r.choice(r.choice(["ab", "asd", "a1"])) for _ in range(r.randrange(1, 12)))
        want = plain_cost(v, ranks)
        assert secrets.guess_cost(v, ranks) == pytest.approx(want), v
        for enough in (3.0, 5.0, 10.0):
            got = secrets.guess_cost(v, ranks, enough)
            assert got == pytest.approx(want) if want < enough else got >= enough, v
