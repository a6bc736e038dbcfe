"""Operators 2, 5, 9 and 10 against slow versions that share no code with them."""

import hashlib
import random
from datetime import date, timedelta

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapeline.llm import jpeg, language, packing, pii

# ---- packing


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))


def ids_of(text):
    return np.frombuffer(packing._encoder(packing.VOCABULARY)(text), "<u4").tolist()


def test_ids_of_all_texts_are_those_of_the_tokenizers_library(spark, tokenizer):
    """Strings of added tokens in a text are what the two may differ by: each holds the mark that sends a text to the library."""
    assert all("<|" in t.content for t in tokenizer.get_added_tokens_decoder().values())
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r.text]
    assert len(texts) >= 1000
    for text, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids_of(text) == e.ids


@given(st.text(max_size=60) | st.text("<|endoftx> \n'sé日  ", max_size=40))
@example("a<|endoftext|><|endoftext|> b<|")
@settings(max_examples=300, deadline=None)
def test_ids_of_any_text(tokenizer, text):
    assert ids_of(text) == tokenizer.encode(text, add_special_tokens=False).ids


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_patterns_are_what_one_search_a_bin_gives(counts):
    left, slow = dict(counts), []
    while any(left.values()):
        chosen = packing.fill(left, 30)
        slow.append(chosen)
        for length, n in chosen:
            left[length] -= n
    assert [c for bins, c in packing.patterns(counts, 30) for _ in range(bins)] == slow


# ---- language


def slow_states(raw, wx, u, c):
    """One unit and one byte at a time."""
    n, h, out = language.UNITS, [0.0] * language.UNITS, []
    gate = lambda v: 1 / (1 + np.exp(-v))
    for byte in raw:
        mixed = [sum(float(u[i, j]) * h[j] for j in range(n)) for i in range(3 * n)]
        reset = [gate(float(wx[i, byte]) + mixed[i]) for i in range(n)]
        update = [gate(float(wx[n + i, byte]) + mixed[n + i]) for i in range(n)]
        new = [np.tanh(float(wx[2 * n + i, byte]) + reset[i] * (mixed[2 * n + i] + float(c[i, 0]))) for i in range(n)]
        h = [update[i] * h[i] + (1 - update[i]) * new[i] for i in range(n)]
        out.append(h)
    return out


def slow_predict(net, text):
    raw, total, letters = text.lower().encode(), np.zeros(len(net["classes"])), 0
    for lo in range(0, len(raw), language.WINDOW):
        part = raw[lo : lo + language.WINDOW]
        padded = part + bytes(language.WINDOW - len(part))  # the way back begins at the window's end
        ahead, behind = slow_states(padded, net["xf"], net["uf"], net["cf"]), slow_states(padded[::-1], net["xb"], net["ub"], net["cb"])[::-1]
        for t, byte in enumerate(part):
            if byte >= 128 or chr(byte).isalpha():
                e = np.exp(net["v"] @ np.array(ahead[t] + behind[t]) + net["k"][:, 0])
                total, letters = total + e / e.sum(), letters + 1
    return net["classes"][int(total.argmax())], total.max() / letters


def test_predictions_of_both_directions_equal_one_unit_at_a_time():
    net, draw = language.new(["a", "b", "c"]), np.random.default_rng(2)
    for name in ("cf", "cb", "k", "v", "uf", "ub"):
        net[name] = draw.normal(size=net[name].shape).astype(np.float32)
    texts = ["x", "ünï 12 Ab.", "one window and some of the next: " * 5, "c" * language.WINDOW, "7 8 9 z"]
    langs, scores = language.predict(net, [*texts, None, "", "12 ..."])
    assert langs[len(texts) :] == ["und"] * 3 and not scores[len(texts) :].any()
    for text, lang, score in zip(texts, langs, scores, strict=False):
        expected, share = slow_predict(net, text)
        assert lang == expected and score == pytest.approx(share, rel=1e-4)


# ---- media


class SlowBits:
    def __init__(self, data):
        self.bits, self.at = "".join(f"{b:08b}" for b in data.replace(b"\xff\x00", b"\xff")), 0

    def take(self, n):
        self.at += n
        return int(self.bits[self.at - n : self.at] or "0", 2)

    def symbol(self, table):
        code = ""
        while code not in table:
            assert len(code) < 17
            code += self.bits[self.at]
            self.at += 1
        return table[code]

    def signed(self, n):
        v = self.take(n)
        return v if n == 0 or v >> (n - 1) else v - (1 << n) + 1


def slow_refine(bits, block, k, bit):
    """A correction of a coefficient that is there already."""
    if bits.take(1) and not abs(block[k]) & bit:
        block[k] += bit if block[k] > 0 else -bit


def slow_band(bits, block, table, low, high, shift, first, run):
    """One block of an AC scan; run: blocks left of an end-of-band run."""
    k, bit = low, 1 << shift
    while k <= high and not run:
        skip, size = divmod(bits.symbol(table), 16)
        if size == 0 and skip < 15:
            run = (1 << skip) + bits.take(skip)
            break
        if first:
            k += skip
            if size:
                block[k] = bits.signed(size) << shift
            k += 1
            continue
        new = (bit if bits.take(1) else -bit) if size else 0
        while k <= high:
            if block[k]:
                slow_refine(bits, block, k, bit)
            elif skip == 0:
                block[k] = new
                break
            else:
                skip -= 1
            k += 1
        k += 1
    if run and not first:
        for k in range(k, high + 1):  # noqa: B020
            if block[k]:
                slow_refine(bits, block, k, bit)
    return max(run - 1, 0)


def slow_coefficients(file):
    """By component a dictionary of (row, column) to the block's 64 coefficients in zigzag order, read bit by bit."""
    at, tables, frame, blocks, every = 2, {}, None, {}, 0
    while file[at + 1] != 0xD9:
        mark, size = file[at + 1], int.from_bytes(file[at + 2 : at + 4], "big")
        body, at = file[at + 4 : at + 2 + size], at + 2 + size
        if mark == 0xC2:
            high, wide = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            frame = {body[6 + 3 * i]: divmod(body[7 + 3 * i], 16) for i in range(body[5])}
            h_max, v_max = max(h for h, _ in frame.values()), max(v for _, v in frame.values())
            across, down = -(-wide // (8 * h_max)), -(-high // (8 * v_max))
            blocks = {c: {(y, x): [0] * 64 for y in range(down * v) for x in range(across * h)} for c, (h, v) in frame.items()}
        elif mark == 0xDD:
            every = int.from_bytes(body, "big")
        elif mark == 0xC4:
            while body:
                counts, place, code, table = body[1:17], 17, 0, {}
                for length, n in enumerate(counts, 1):
                    for _ in range(n):
                        table[f"{code:0{length}b}"] = body[place]
                        code, place = code + 1, place + 1
                    code <<= 1
                tables[body[0]], body = table, body[place:]
        elif mark == 0xDA:
            chosen = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            low, top, approx = body[-3:]
            before, shift = divmod(approx, 16)
            parts, end = [], at
            while not parts or 0xD0 <= file[end + 1] <= 0xD7:  # up to each restart and the scan's end
                first = end = end + 2 if parts else at
                while file[end] != 0xFF or file[end + 1] == 0:
                    end += 1
                parts.append(file[first:end])
            at = end
            if len(chosen) > 1:
                units = [[(c, t, (my * frame[c][1] + y, mx * frame[c][0] + x)) for c, t in chosen for y in range(frame[c][1]) for x in range(frame[c][0])] for my in range(down) for mx in range(across)]
            else:
                ((c, t),) = chosen
                h, v = frame[c]
                rows, columns = (-(-whole * n // (8 * most)) for whole, n, most in ((high, v, v_max), (wide, h, h_max)))
                units = [[(c, t, (y, x))] for y in range(rows) for x in range(columns)]
            every_part = every or len(units)
            assert len(parts) == -(-len(units) // every_part)
            for nth, part in enumerate(parts):
                bits, last, run = SlowBits(part), dict.fromkeys(frame, 0), 0
                for c, t, place in [x for unit in units[nth * every_part : (nth + 1) * every_part] for x in unit]:
                    block = blocks[c][place]
                    if low == 0 and before == 0:
                        last[c] += bits.signed(bits.symbol(tables[t >> 4]))
                        block[0] = last[c] << shift
                    elif low == 0:
                        block[0] |= bits.take(1) << shift
                    else:
                        run = slow_band(bits, block, tables[16 | t & 15], low, top, shift, before == 0, run)
                assert not run and len(bits.bits) - bits.at < 8
    return blocks


def test_files_read_bit_by_bit_hold_the_same_coefficients():
    draw = np.random.default_rng(9)
    texts = [b"", b"a", bytes(range(256)) * 3, b"plain words of a text, again and again. " * 40, draw.integers(0, 256, 3000, dtype=np.uint8).tobytes(), bytes(5000)]
    files = jpeg.encode([jpeg.padded(t) for t in texts])
    images, coefs = jpeg.coefficients(files)
    refined = 0
    for file, image in zip(files, images, strict=True):
        slow = list(slow_coefficients(file).values())
        assert len(slow) == len(image.components)
        for part, blocks in zip(image.components, slow, strict=True):
            for (y, x), block in blocks.items():
                assert coefs[part.first + y * part.wide + x].tolist() == block
                refined += sum(map(bool, block))
    assert refined > 5000


# ---- personal data


def slow_rounds(kind, left, right, a, b, back=False):
    for i in reversed(range(pii.ROUNDS)) if back else range(pii.ROUNDS):
        size, other = (a, right) if i % 2 == 0 else (b, left)
        add = int(hashlib.sha256(f"key|{kind}|{i}|{size}|{other}".encode()).hexdigest()[:15], 16) * (-1 if back else 1)
        left, right = ((left + add) % a, right) if i % 2 == 0 else (left, (right + add) % b)
    return left, right


def slow_digits(kind, x, back=False):
    h = len(x) // 2
    left, right = slow_rounds(kind, int(x[:h]), int(x[h:]), 10**h, 10 ** (len(x) - h), back)
    return f"{left:0{h}d}{right:0{len(x) - h}d}"


def slow_date(x, back=False):
    n = (date.fromisoformat(x) - date(1800, 1, 1)).days
    left, right = slow_rounds("date", n // 773, n % 773, 189, 773, back)
    return (date(1800, 1, 1) + timedelta(days=left * 773 + right)).isoformat()


def slow_ip(x, back=False):
    p = list(map(int, x.split(".")))
    left, right = slow_rounds("ip", p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, back)
    return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"


def slow_ssn(x, back=False):
    area, group, serial = map(int, x.split("-"))
    areas = [k for k in range(1, 900) if k != 666]
    left, right = slow_rounds("ssn", areas.index(area) * 99 + group - 1, serial - 1, 898 * 99, 9999, back)
    return f"{areas[left // 99]:03d}-{left % 99 + 1:02d}-{right + 1:04d}"


def luhn_digit(body):
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(body)))
    return str(-total % 10)


def slow_card(x, back=False):
    body = slow_digits("card", x[:-1], back)
    return body + luhn_digit(body)


def checked(country, account):
    number = int("".join(str(int(c, 36)) for c in account + country + "00"))
    return f"{country}{98 - number % 97:02d}{account}"


def slow_iban(x, back=False):
    fresh = iter(slow_digits("iban", "".join(c for c in x[4:] if c.isdigit()), back))
    return checked(x[:2], "".join(next(fresh) if c.isdigit() else c for c in x[4:]))


def test_pseudonyms_equal_a_slow_feistel_and_go_back(spark):
    rng = random.Random(7)
    some = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    ends = ["1800-01-01", "2199-12-31", "2000-02-29", "1900-03-01"]
    bodies = [some(rng.randint(12, 18)) for _ in range(60)]
    cases = {
        slow_date: ends + [(date(1800, 1, 1) + timedelta(days=rng.randrange(146097))).isoformat() for _ in range(60)],
        slow_ip: ["0.0.0.0", "255.255.255.255"] + [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(40)],
        slow_ssn: ["001-01-0001", "899-99-9999", "665-01-0001", "667-99-0001"] + [f"{rng.choice([k for k in range(1, 900) if k != 666]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}" for _ in range(40)],
        slow_card: [b + luhn_digit(b) for b in bodies],
        slow_iban: [checked("DE", some(18)) for _ in range(30)] + [checked("GB", "NWBK" + some(14)) for _ in range(30)],
    }
    rows = [(slow.__name__, x) for slow, values in cases.items() for x in values]
    df = spark.createDataFrame(rows, "kind string, x string").withColumn("y", pii.pseudonym(F.col("x"), "key"))
    found = {(r.kind, r.x): r.y for r in df.collect()}
    for slow, values in cases.items():
        for x in values:
            y = found[slow.__name__, x]
            assert y == slow(x) and slow(y, back=True) == x


def test_digits_of_every_length_go_back(spark):
    rng = random.Random(8)
    rows = [("".join(rng.choice("0123456789") for _ in range(n)),) for n in range(2, 37) for _ in range(4)]
    for r in spark.createDataFrame(rows, "x string").withColumn("y", pii.digits("key", "t", F.col("x"))).collect():
        assert r.y == slow_digits("t", r.x) and slow_digits("t", r.y, back=True) == r.x


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, size int, _found string")
    for out in (packing.pack(docs), jpeg.store(docs), pii.pseudonymise(docs.drop("_found"))):
        assert out.count() == 0 and "doc_id" in out.columns
