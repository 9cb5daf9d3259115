"""Fixed tables: phonon lexicon, romaji keys, letter names, and the default distance matrices.

All are built once on the driver and are of fixed size (at most a few hundred keys).
"""

from __future__ import annotations

from functools import cache

VOWELS = "aiueo"

# Rows of the phonon lexicon, as (consonant code, vowel code, kana for a i u e o; "-" where there is none).
PHONON_ROWS = (
    ("w", "w", "ウァ ウィ - ウェ ウォ"), ("w", "w", "ウヮ - - - -"),
    ("k", "k", "カ キ ク ケ コ"), ("g", "g", "ガ ギ グ ゲ ゴ"),
    ("ky", "y", "キャ - キュ キェ キョ"), ("gy", "y", "ギャ - ギュ ギェ ギョ"),
    ("k", "k", "クァ クィ - クェ クォ"), ("k", "k", "クヮ - - - -"), ("g", "g", "グァ グィ - グェ グォ"), ("g", "g", "グヮ - - - -"),
    ("s", "s", "サ - ス セ ソ"), ("sh", "y", "シャ シ シュ シェ ショ"), ("z", "z", "ザ - ズ ゼ ゾ"), ("j", "y", "ジャ ジ ジュ ジェ ジョ"),
    ("s", "s", "スァ スィ - スェ スォ"), ("s", "s", "スヮ - - - -"), ("z", "z", "ズァ ズィ - ズェ ズォ"), ("z", "z", "ズヮ - - - -"),
    ("t", "t", "タ - - テ ト"), ("ch", "y", "チャ チ チュ チェ チョ"), ("ts", "s", "- - ツ - -"), ("d", "d", "ダ ヂ ヅ デ ド"), ("dy", "y", "ヂャ - ヂュ ヂェ ヂョ"),
    ("ts", "s", "ツァ ツィ - ツェ ツォ"), ("ts", "s", "ツヮ - - - -"),
    ("t", "t", "- ティ テュ - -"), ("t", "t", "- - トゥ - -"), ("d", "d", "- ディ デュ - -"), ("d", "d", "- - ドゥ - -"),
    ("n", "n", "ナ ニ ヌ ネ ノ"), ("ny", "y", "ニャ - ニュ ニェ ニョ"), ("n", "n", "ヌァ ヌィ - ヌェ ヌォ"), ("n", "n", "ヌヮ - - - -"),
    ("h", "h", "ハ ヒ - ヘ ホ"), ("f", "f", "ファ フィ フ フェ フォ"), ("f", "f", "フヮ - - - -"), ("b", "b", "バ ビ ブ ベ ボ"), ("p", "p", "パ ピ プ ペ ポ"),
    ("hy", "y", "ヒャ - ヒュ ヒェ ヒョ"), ("hy", "y", "- - フュ - -"), ("by", "y", "ビャ - ビュ ビェ ビョ"), ("py", "y", "ピャ - ピュ ピェ ピョ"),
    ("b", "b", "ブァ ブィ - ブェ ブォ"), ("b", "b", "ブヮ - - - -"), ("p", "p", "プァ プィ - プェ プォ"), ("p", "p", "プヮ - - - -"),
    ("m", "m", "マ ミ ム メ モ"), ("my", "y", "ミャ - ミュ ミェ ミョ"), ("m", "m", "ムァ ムィ - ムェ ムォ"), ("m", "m", "ムヮ - - - -"),
    ("y", "y", "ヤ - ユ イェ ヨ"), ("r", "r", "ラ リ ル レ ロ"), ("ry", "y", "リャ - リュ リェ リョ"), ("w", "w", "ワ - - - -"),
    ("b", "b", "ヴァ ヴィ ヴ ヴェ ヴォ"), ("b", "b", "ヴヮ - - - -"),
)
# Kana without a consonant row.
PHONON_SINGLE = {"sp": ("sp", "sp"), "ッ": ("sp", "q"), "ン": ("sp", "N"), "ア": ("sp", "a"), "イ": ("sp", "i"), "ウ": ("sp", "u"), "エ": ("sp", "e"), "オ": ("sp", "o"), "ヲ": ("sp", "o")}


@cache
def phonons() -> dict[str, tuple[str, str]]:
    """Kana unit to (consonant code, vowel code), without long-bar variants."""
    out = dict(PHONON_SINGLE)
    for c, v, row in PHONON_ROWS:
        for x, kana in zip(VOWELS, row.split()):
            if kana != "-":
                out[kana] = (f"{c}+{x}", f"{v}-{x}")
    return out


@cache
def units() -> dict[str, tuple[str, str]]:
    """phonons() and, of each kana that ends in a vowel, its long-bar variant."""
    out = dict(phonons())
    for kana, (c, v) in phonons().items():
        if v[-1] in VOWELS:
            out[kana + "ー"] = (c, v + ":")
    return out


# Romaji prefix and its kana before a, i, u, e and o.
ROMAJI_ROWS = """
. ア イ ウ エ オ
k カ キ ク ケ コ
ky キャ キィ キュ キェ キョ
s サ シ ス セ ソ
sh シャ シ シュ シェ ショ
sy キャ キィ キュ キェ キョ
t タ チ ツ テ ト
th テャ ティ テュ テェ テョ
ty チャ チィ チュ チェ チョ
ts ツァ ツィ ツ ツェ ツォ
c カ シ ク セ コ
ch チャ チ チュ チェ チョ
cy チャ チィ チュ チェ チョ
q クァ クィ ク クェ クォ
n ナ ニ ヌ ネ ノ
ny ニャ ニィ ニュ ニェ ニョ
h ハ ヒ フ ヘ ホ
hy ヒャ ヒィ ヒュ ヒェ ヒョ
f ファ フィ フ フェ フォ
fy フャ - フュ - フョ
m マ ミ ム メ モ
my ミャ ミィ ミュ ミェ ミョ
y ヤ イ ユ イェ ヨ
r ラ リ ル レ ロ
ry リャ リィ リュ リェ リョ
w ワ ウィ ウ ウェ ヲ
g ガ ギ グ ゲ ゴ
gy ギャ ギィ ギュ ギェ ギョ
z ザ ジ ズ ゼ ゾ
zy ジャ ジィ ジュ ジェ ジョ
j ジャ ジ ジュ ジェ ジョ
jy ジャ ジィ ジュ ジェ ジョ
d ダ ヂ ヅ デ ド
dh デャ ディ デュ デェ デョ
dy ヂャ ヂィ ヂュ ヂェ ヂョ
b バ ビ ブ ベ ボ
by ビャ ビィ ビュ ビェ ビョ
v ヴァ ヴィ ヴ ヴェ ヴォ
vy ヴャ ヴィ ヴュ ヴェ ヴョ
p パ ピ プ ペ ポ
py ピャ ピィ ピュ ピェ ピョ
x ァ ィ ゥ ェ ォ
xy ャ ィ ュ ェ ョ
xt - - ッ - -
xts - - ッ - -
l ァ ィ ゥ ェ ォ
ly ャ ィ ュ ェ ョ
lt - - ッ - -
lts - - ッ - -
"""


@cache
def romaji() -> dict[str, str]:
    """Romaji key to kana; no key is a prefix of another."""
    out = {"nn": "ン"}
    for line in ROMAJI_ROWS.split("\n"):
        if line:
            prefix, *kana = line.split()
            out |= {prefix.strip(".") + v: k for v, k in zip(VOWELS, kana) if k != "-"}
    return out


@cache
def romaji_pattern() -> str:
    """One romaji key, in a form that Java's, Python's and RE2's engines read alike."""
    by: dict[str, str] = {}
    for key in sorted(romaji()):
        if key != "nn":
            by[key[:-1]] = by.get(key[:-1], "") + key[-1]
    return "(?:nn|" + "|".join(f"{p}[{v}]" for p, v in sorted(by.items(), key=lambda x: (-len(x[0]), x[0]))) + ")"


#: Names of the letters A to Z in kana: our own table.
LETTER_NAMES = dict(zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "エー ビー シー ディー イー エフ ジー エイチ アイ ジェー ケー エル エム エヌ オー ピー キュー アール エス ティー ユー ブイ ダブリュー エックス ワイ ゼット".split()))
#: A small English dictionary of our own; pass another where the operators take one.
ENGLISH = {"LOVE": "ラヴ", "CAT": "キャット", "DOG": "ドッグ", "RING": "リング", "BOLT": "ボルト", "STEEL": "スチール", "THE": "ザ", "AND": "アンド", "ON": "オン", "RED": "レッド", "BLUE": "ブルー", "GREEN": "グリーン"}
#: A small kanji dictionary of our own, each kanji's readings by falling length.
KANJI = {"山": ["サン", "ヤマ"], "川": ["カワ", "セン"], "東": ["ヒガシ", "トウ"], "京": ["キョウ", "ケイ"], "日": ["ニチ", "ジツ", "ヒ"], "本": ["ホン", "モト"], "花": ["ハナ", "カ"], "火": ["ヒ", "カ"], "大": ["ダイ", "オオ"], "小": ["ショウ", "コ"], "人": ["ジン", "ニン", "ヒト"], "空": ["ソラ", "クウ"]}


def vowel_distance(a: str, b: str) -> int:
    """Our own integer matrix: 0 for equals, 20 for length alone, at most 80."""
    if a == b:
        return 0
    quality = lambda v: v.rstrip(":")[-1] if v.rstrip(":")[-1] in VOWELS else v
    x, y = quality(a), quality(b)
    far = {frozenset("ie"): 24, frozenset("ou"): 24, frozenset("ae"): 32, frozenset("ao"): 32, frozenset("iu"): 40, frozenset("eo"): 44, frozenset("au"): 44, frozenset("ai"): 48, frozenset("eu"): 44, frozenset("io"): 52}
    if x in VOWELS and y in VOWELS:
        base = 0 if x == y else far[frozenset((x, y))]
    else:
        base = 60
    glide = 4 if a.rstrip(":")[:-1] != b.rstrip(":")[:-1] else 0
    return min(80, base + glide + (20 if a.endswith(":") != b.endswith(":") else 0))


# place, manner and voice of each consonant code: our own features
_FEATURES = {"sp": (9, 9, 0), "k": (5, 0, 0), "g": (5, 0, 1), "ky": (4, 0, 0), "gy": (4, 0, 1), "s": (2, 1, 0), "z": (2, 1, 1), "sh": (3, 1, 0), "j": (3, 1, 1), "t": (2, 0, 0), "d": (2, 0, 1), "ch": (3, 2, 0), "dy": (3, 0, 1), "ts": (2, 2, 0), "n": (2, 3, 1), "ny": (3, 3, 1), "h": (6, 1, 0), "hy": (4, 1, 0), "f": (1, 1, 0), "b": (1, 0, 1), "by": (3, 0, 1), "p": (1, 0, 0), "py": (3, 0, 0), "m": (1, 3, 1), "my": (3, 3, 1), "y": (3, 4, 1), "r": (2, 4, 1), "ry": (3, 4, 1), "w": (1, 4, 1)}


def consonant_distance(a: str, b: str) -> int:
    """Our own integer matrix over consonant codes: weighted feature distance, even, at most 80."""
    x, y = a.split("+")[0], b.split("+")[0]
    if x == y:
        return 0
    if "sp" in (x, y):
        return 60
    p, q = _FEATURES[x], _FEATURES[y]
    return min(80, 4 * abs(p[0] - q[0]) + 12 * (p[1] != q[1]) + 8 * (p[2] != q[2]) + 4)


@cache
def vowel_names() -> dict[str, str]:
    """Kana to its vowel in kana, with long bars and the vowel pairs エイ and オウ; ン, ッ and the pause have none of these."""
    names = dict(zip("aiueopNq", ["ア", "イ", "ウ", "エ", "オ", "sp", "sp", "sp"]))
    out = {}
    for kana, (_, v) in phonons().items():
        vowel = names[v[-1]]
        ends = [""] if kana in ("ン", "ッ", "sp") else ["", "ー"] + {"エ": ["イ"], "オ": ["ウ"]}.get(vowel, [])
        out |= {kana + e: vowel for e in ends}
    return out


@cache
def vowel_matrix() -> dict[tuple[str, str], int]:
    codes = sorted({v for _, v in units().values()})
    return {(a, b): vowel_distance(a, b) for a in codes for b in codes}


@cache
def consonant_matrix() -> dict[tuple[str, str], int]:
    codes = sorted({c for c, _ in units().values()})
    return {(a, b): consonant_distance(a, b) for a in codes for b in codes}
