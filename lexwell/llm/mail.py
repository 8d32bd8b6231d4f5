"""Problem 1: the text newly written by the sender of a mail, without quotations, signature and automatic text.

Method: a mail is cut into paragraphs and these, at changes of the quotation mark and at markers, into blocks of lines;
gradient-boosted trees classify the lines, and the mean over a block decides for all of its lines. What the trees see of
a line: quotation depth, contact density, place relative to closing phrase, headers and rules, how many mails of its
sender and how many senders have the same line (sender frequency), and in how many mails it stands unquoted (ancestor
overlap).

There are no labelled mails. The trees are trained on a bounded sample of mails (``max_training_mails``) whose lines are
labelled by three kinds of evidence: marks in the mail (quotation marks, header blocks, the place after a closing phrase),
other mails (a first or last line that many senders have), and wording. The wording of notices is learnt, not listed: words
are weighed by how much more often they stand in long lines after a closing phrase than in text before it, and so tell
notices that no closing phrase precedes. Lines of the sample after a closing phrase are also shown to the trees with
wording or counts hidden, so that neither alone decides.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexwell.llm.boosting import BoostedTrees
from lexwell.llm.canonical import canonical
from lexwell.llm.common import saved, ship
from lexwell.llm.mojibake import Plausibility, Repair

# Reply and forward marks of mail programs.
SUBJECT_MARKS = (
    "re", "aw", "antw", "antwort", "sv", "vs", "vl", "vb", "wg", "fw", "fwd", "tr", "i", "r", "rif", "rv", "enc", "res", "doorst", "vá", "továbbítás",
    "ynt", "ilt", "odp", "pd", "на", "ha", "пересл", "отв", "fs", "bls", "ref", "rép", "réf", "videresendt", "vidarebefordrat", "välitetty", "ответ",
)
# Closing phrases.
CLOSINGS = (
    "kind regards", "best regards", "warm regards", "regards", "yours sincerely", "sincerely", "yours faithfully", "many thanks", "thanks", "thank you",
    "cheers", "best wishes", "all the best", "best", "take care", "talk soon", "br", "mfg", "lg", "vg", "mit freundlichen grüßen", "freundliche grüße", "viele grüße", "beste grüße", "schöne grüße",
    "herzliche grüße", "liebe grüße", "vielen dank", "hochachtungsvoll", "cordialement", "bien cordialement", "bien à vous", "sincères salutations",
    "merci d'avance", "salutations distinguées", "saludos cordiales", "un saludo", "saludos", "atentamente", "muchas gracias", "muito obrigado",
    "com os melhores cumprimentos", "atenciosamente", "cumprimentos", "grazie mille", "cordiali saluti", "un saluto", "distinti saluti", "saluti",
    "alvast bedankt", "met vriendelijke groet", "met vriendelijke groeten", "groeten", "hoogachtend", "med vänlig hälsning", "med vänliga hälsningar",
    "hälsningar", "tack på förhand", "med venlig hilsen", "mange hilsner", "venlig hilsen", "på forhånd tak", "terveisin", "ystävällisin terveisin",
    "kiitos etukäteen", "с уважением", "заранее спасибо", "всего доброго", "с наилучшими пожеланиями", "üdvözlettel", "tisztelettel",
    "előre is köszönöm", "cu stimă", "toate cele bune", "mulțumesc anticipat", "cu respect", "saygılarımla", "selamlar", "şimdiden teşekkürler",
)
# Marks of quoted lines: > and |, a colon before a space, initials before >.
MARK = r"^\s*(?:(?:[>|]|:(?=\s|$)|[A-Z]{1,3}>)\s?)+"
_MARK = re.compile(MARK)
_HEADER = re.compile(r"^\*?([^\W\d_][^\W\d_ ]{0,13})\s?:\*?(?:\s|$)")
_RULE = re.compile(r"^\s*(?:[-_=~*—–‐]\s?){1,}$")
_MESSAGE = re.compile(r"^\s*[-_=*]{4,}\s?[^\W\d_].*[^\W_]\s?[-_=*]{4,}\s*$")
_PHONE = re.compile(r"(?:\+|\b)\d[\d ()/.-]{6,}\d\b")
_ADDRESS = re.compile(r"\S+@\S+|www\.\S+|https?:\S+|\[cid:[^\]]*\]")
_POSTAL = re.compile(r"\b\d{4,6}\b")
_DATE = re.compile(r"\d{1,4}[./-]\d{1,2}[./-]\d{1,4}")
_ENDS = re.compile(r"[.!?…:;][)\"'”’»\]]*\s*$")
_DIGIT = re.compile(r"\d")
_SUBJECT = re.compile(rf"^\s*(?:{'|'.join(map(re.escape, SUBJECT_MARKS))})\s?(?:\[\d+\]|\(\d+\))?\s?:", re.I)
_TOKEN = re.compile(r"[^\W\d_]{2,}")
_closing = {re.sub("[^\x00-\x7f]", "�", c): c for c in CLOSINGS}
_CLOSING = frozenset(CLOSINGS)


def is_reply_subject(subject: str | None) -> bool:
    return bool(subject) and bool(_SUBJECT.match(canonical(subject) or ""))


def _is_closing(line: str) -> bool:
    plain = line.strip().rstrip(",.!;").strip().lower().replace("’", "'")
    if plain in _CLOSING:
        return True
    return "�" in plain and re.sub("[^\x00-\x7f]", "�", plain) in _closing


def normal_line(line: str) -> str:
    """A line without quotation marks, case and words that hold digits, by which lines of different mails are compared."""
    return " ".join(w for w in _MARK.sub("", line).lower().split() if not _DIGIT.search(w))


FEATURES = (
    "depth", "wrapped", "introduction", "header", "after_header", "message_rule", "rule", "closing", "after_closing", "lines_after_closing",
    "contact", "has_address", "has_phone", "postal", "wording", "wording_paragraph", "sentence_end", "words", "length", "lower_start", "first",
    "from_end", "paragraph_from_end", "paragraph_lines", "below_rule", "same_sender", "mails", "senders", "unquoted", "share_of_sender",
    "quoted_before", "quoted_after", "previous_quoted", "next_quoted", "ends_colon", "date", "name_like", "bracketed", "capitals", "full_stop",
)
_F = {n: i for i, n in enumerate(FEATURES)}


def describe(lines: list[str], counts: dict[int, tuple[int, int, int, int]], sender_mails: int = 1, wording: dict[str, float] | None = None) -> np.ndarray:
    """The features of each line; ``counts`` by line number (from 1): mails of the sender, mails, senders, unquoted."""
    n = len(lines)
    x = np.zeros((n, len(FEATURES)))
    bare = [_MARK.sub("", l) for l in lines]
    blank = [not l.strip() for l in lines]
    depth = [len(re.findall(r"[>|:]", m.group())) if (m := _MARK.match(l)) else 0 for l in lines]
    quoted = [d > 0 for d in depth]
    wrapped = [False] * n
    for i in range(n):  # pieces that were broken off a quoted line
        if quoted[i] or blank[i] or i == 0:
            continue
        if quoted[i - 1] and bare[i - 1].strip():
            following = next((j for j in range(i + 1, n) if quoted[j] or blank[j]), n)
            cut_before = not _ENDS.search(bare[i - 1]) and not _is_closing(bare[i - 1])
            cut_after = following < n and quoted[following] and following == i + 1 and not _ENDS.search(lines[i])
            wrapped[i] = (cut_before or cut_after) and len(lines[i]) < 60
    intro = [False] * n
    for i in range(n):
        if quoted[i] and not (i and (quoted[i - 1] or wrapped[i - 1])):
            j = i - 1
            while j >= 0 and blank[j]:
                j -= 1
            if j >= 0 and not quoted[j] and lines[j].rstrip().endswith(":") and (_DATE.search(lines[j]) or "@" in lines[j] or len(lines[j].split()) < 8):
                intro[j] = True
                k = j - 1
                begins = k == 0 or k > 0 and (blank[k - 1] or quoted[k - 1])
                if k >= 0 and begins and not blank[k] and not quoted[k] and not _ENDS.search(lines[k]) and len(lines[k]) < 80:
                    intro[k] = True  # an introduction over two lines
    head = [bool(_HEADER.match(l)) and not quoted[i] for i, l in enumerate(lines)]
    header = [False] * n
    i = 0
    while i < n:
        j = i
        while j < n and head[j]:
            j += 1
        if j - i >= 3:
            header[i:j] = [True] * (j - i)
        i = max(j, i + 1)
    message = [bool(_MESSAGE.match(l)) and not quoted[i] for i, l in enumerate(lines)]
    rule = [bool(_RULE.match(l)) and not quoted[i] for i, l in enumerate(lines)]
    closing = [not quoted[i] and _is_closing(l) for i, l in enumerate(lines)]
    paragraphs = np.cumsum([blank[i] or (i > 0 and quoted[i] != quoted[i - 1]) for i in range(n)]) if n else np.zeros(0, int)
    known = wording or {}
    said = [[known.get(w, 0.0) for w in _TOKEN.findall(l.lower())] if known and not quoted[i] else [] for i, l in enumerate(bare)]
    after_header, after_closing, since, below = False, False, 0, 0
    seen_quote = 0
    total_quoted = sum(quoted)
    last = max((i for i in range(n) if not blank[i]), default=-1)
    sums, sizes, pieces, piece = {}, {}, [], 0
    for i in range(n):
        piece += closing[i] or (i > 0 and closing[i - 1])  # a closing phrase ends what is read together
        pieces.append((paragraphs[i], piece))
        sums.setdefault(pieces[i], []).extend(said[i])
        sizes[paragraphs[i]] = sizes.get(paragraphs[i], 0) + (not blank[i])
    for i in range(n):
        l = lines[i]
        if blank[i]:
            continue
        if header[i] or message[i]:
            after_header = True
        words = l.split()
        addresses = sum(len(m.group()) for m in _ADDRESS.finditer(l)) if "@" in l or "www." in l or "http" in l or "[cid" in l else 0
        phones = sum(len(m.group()) for m in _PHONE.finditer(l)) if (figures := bool(_DIGIT.search(l))) else 0
        contact = addresses + phones
        c = counts.get(i + 1, (1, 1, 1, 0 if quoted[i] else 1))
        x[i] = (
            depth[i], wrapped[i], intro[i], header[i], after_header, message[i], rule[i], closing[i], after_closing, since, contact / max(len(l), 1),
            addresses > 0, phones > 0, figures and bool(_POSTAL.search(l)), _mean(said[i]), _mean(sums[pieces[i]]), bool(_ENDS.search(l)), len(words),
            len(l), l.lstrip()[:1].islower(), i == 0, last - i, paragraphs[last] - paragraphs[i], sizes[paragraphs[i]], below,
            c[0], c[1], c[2], c[3], c[0] / max(sender_mails, 1), seen_quote, total_quoted - seen_quote - quoted[i], i > 0 and quoted[i - 1],
            i + 1 < n and quoted[i + 1], l.rstrip().endswith(":"), figures and bool(_DATE.search(l)), len(words) <= 2 and all(w[:1].isupper() for w in words),
            l.lstrip().startswith("["), sum(map(str.isupper, l)) / max(len(l), 1),
            l.rstrip().endswith((".", "]")),
        )
        seen_quote += quoted[i]
        below = below + 1 if below or rule[i] else 0
        if closing[i] and not after_header:
            after_closing, since = True, 0
        elif after_closing:
            since += 1
    return x


def _mean(values: list[float]) -> float:
    return sum(values) / len(values) if len(values) >= 4 else 0.0  # a few words say nothing


def learnt_wording(described: list[tuple[list[str], np.ndarray]], most: int = 20_000) -> dict[str, float]:
    """How much more often words stand in long lines after a closing phrase than in text before it, as log odds from -3 to 3."""
    after, before = Counter(), Counter()
    f = _F
    for lines, x in described:
        for l, v in zip(lines, x):
            if v[f["words"]] < 5 or v[f["depth"]] or v[f["wrapped"]] or v[f["header"]] or v[f["after_header"]] or v[f["introduction"]]:
                continue
            (after if v[f["after_closing"]] else before).update(set(_TOKEN.findall(l.lower())))
    size = 0.5 * len(after | before) + 1
    n_after, n_before = sum(after.values()) + size, sum(before.values()) + size
    odds = {w: float(np.log((after[w] + 0.5) / n_after) - np.log((before[w] + 0.5) / n_before)) for w, n in (after + before).most_common(most) if n >= 3}
    return {w: min(max(v, -3.0), 3.0) for w, v in odds.items()}


NOTICE, PLAIN = 0.8, 0.3  # mean log odds from which wording tells a notice, and up to which it tells own text


def certain(lines: list[str], x: np.ndarray) -> np.ndarray:
    """1: surely not newly written; 0: surely newly written; -1: left out of the training."""
    y = np.full(len(lines), -1)
    f = {k: x[:, i] for k, i in _F.items()}
    y[(f["after_closing"] == 0) & (f["wording_paragraph"] < PLAIN)] = 0
    y[(f["depth"] > 0) | (f["wrapped"] > 0) | (f["introduction"] > 0) | (f["header"] > 0) | (f["message_rule"] > 0) | (f["after_header"] > 0)] = 1
    y[(f["rule"] > 0) | ((f["after_closing"] > 0) & (f["after_header"] == 0))] = 1
    plain = (f["after_closing"] == 0) & (y != 1)
    # Lines that many senders have, at the very beginning or end of a mail, are those of mail systems.
    banner = plain & (f["first"] > 0) & (f["senders"] >= 3) & (f["words"] >= 4) & ((f["full_stop"] > 0) | (f["bracketed"] > 0))
    tail = plain & (f["from_end"] == 0) & (f["words"] <= 8) & (f["senders"] >= 4) & (f["closing"] == 0) & (f["paragraph_lines"] == 1) & (f["sentence_end"] == 0)
    y[plain & (f["wording_paragraph"] >= NOTICE)] = 1
    y[banner | tail] = 1
    y[(f["closing"] > 0) & (f["depth"] == 0) & (f["after_header"] == 0)] = 0
    return y


HIDDEN = (("wording", "wording_paragraph"), ("same_sender", "mails", "senders", "unquoted", "share_of_sender"))


def training_rows(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The labelled lines, and those after a closing phrase once more with each kind of ``HIDDEN`` features hidden."""
    xs, ys = [x], [y]
    for names in HIDDEN:
        after = x[:, _F["after_closing"]] > 0
        copy = x[after].copy()
        copy[:, [_F[n] for n in names]] = [1.0 if n in ("same_sender", "mails", "senders", "unquoted") else 0.0 for n in names]
        xs.append(copy)
        ys.append(y[after])
    return np.concatenate(xs), np.concatenate(ys)


def blocks_of(x: np.ndarray, shown: list[int]) -> np.ndarray:
    """The block number of each shown (non-blank) line: blocks end at blank lines, where quotation begins or ends, and at markers."""
    marker = sum((x[:, _F[n]] * k for k, n in enumerate(("closing", "header", "introduction", "message_rule", "rule", "after_closing"), 1)), np.zeros(len(x)))
    marker = marker + 100 * ((x[:, _F["senders"]] >= 3) & (x[:, _F["words"]] >= 4))  # a line that many senders have stands for itself
    out, number = np.zeros(len(shown), np.int64), 0
    for k, i in enumerate(shown):
        if k and (i != shown[k - 1] + 1 or (x[i, _F["depth"]] > 0) != (x[i - 1, _F["depth"]] > 0) or marker[i] != marker[i - 1]):
            number += 1
        out[k] = number
    return out


def _split(text: str, repair: Repair) -> list[str]:
    if not text.isascii():
        text = repair.text(text)[1] if repair.suspicious(text) else text
    return [l if l.isascii() else canonical(l).replace("\n", " ") for l in text.split("\n")]


def _lines(samples: list[tuple[str, str]], kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repair = Repair(Plausibility.learn(samples))
        for batch in batches:
            lines = [_split(t, repair) for t in batch["t"]]
            yield pd.DataFrame({"r": batch["r"], "sender": batch["sender"], "lines": lines, "norm": [[normal_line(l) for l in ls] for ls in lines]})

    return run, f"r {kind}, sender string, lines array<string>, norm array<string>"


def newly_written(
    df: DataFrame, record: str, text: str, sender: str, samples: list[tuple[str, str]], max_training_mails: int = 1500, trees: int = 60
) -> DataFrame:
    """(record, line_no, line, block, depth, other, probability) of each non-blank line of each mail; ``other``: not newly written.

    ``block`` numbers the blocks of a mail from 1; all lines of a block have its probability and class, ``depth`` is the depth
    of quotation of the line.

    Lines count from 1 and are separated by \\n; ``line`` is in canonical form. Mails with null text or id have no rows;
    a null sender is a sender of its own. Ids are taken to be unique: rows with the same id count as one sender's mails
    but get their lines' counts together. Counts of lines cover all mails; training takes the ``max_training_mails``
    mails whose id has the lowest hash.
    """
    spark = df.sparkSession
    ship(spark)
    kind = df.schema[record].dataType.simpleString()
    run, schema = _lines(samples, kind)
    mails = saved(
        df.where(F.col(text).isNotNull() & F.col(record).isNotNull())
        .select(F.col(record).alias("r"), F.col(sender).cast("string").alias("sender"), F.col(text).alias("t"))
        .mapInPandas(run, schema)
    )
    ready = saved(mails.select("r", "lines").join(_counted(mails), "r", "left"))
    training = ready.orderBy(F.xxhash64("r"), "r").limit(max_training_mails).toPandas()
    listed = [(list(row.lines), _counts(row.counts), int(row.sender_mails) if row.sender_mails == row.sender_mails else 1) for row in training.itertuples()]
    wording = learnt_wording([(lines, describe(lines, counts, n)) for lines, counts, n in listed])
    xs, ys = [], []
    for lines, counts, n in listed:
        x = describe(lines, counts, n, wording)
        y = certain(lines, x)
        keep = (y >= 0) & np.array([bool(l.strip()) for l in lines], bool)
        xs.append(x[keep])
        ys.append(y[keep])
    x, y = training_rows(np.concatenate(xs), np.concatenate(ys)) if xs else (np.zeros((0, len(FEATURES))), np.zeros(0))
    model = BoostedTrees.train(x, y.astype(float), trees=trees)

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[str, list] = {"r": [], "line_no": [], "line": [], "block": [], "depth": []}
            xs = []
            for row in batch.itertuples():
                lines = list(row.lines)
                x = describe(lines, _counts(row.counts), int(row.sender_mails) if row.sender_mails == row.sender_mails else 1, wording)
                shown = [i for i, l in enumerate(lines) if l.strip()]
                out["r"] += [row.r] * len(shown)
                out["line_no"] += [i + 1 for i in shown]
                out["line"] += [lines[i] for i in shown]
                out["block"] += (blocks_of(x, shown) + 1).tolist()
                out["depth"] += x[shown, _F["depth"]].astype(int).tolist()
                xs.append(x[shown])
            if not out["r"]:
                continue
            made = pd.DataFrame(out)
            made["p"] = model.probability(np.concatenate(xs))
            made["probability"] = made.groupby(["r", "block"], sort=False)["p"].transform("mean")
            yield made.assign(other=made["probability"] >= 0.5)[["r", "line_no", "line", "block", "depth", "other", "probability"]]

    columns = f"r {kind}, line_no int, line string, block int, depth int, other boolean, probability double"
    return ready.mapInPandas(classify, columns).withColumnRenamed("r", record)


HOT = 100_000  # keys with more than one in HOT of the rows are joined by broadcasting; there are fewer than HOT of them


def _looked_up(rows: DataFrame, values: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """``rows`` left joined to ``values``, one row a key with the number of its rows in ``count``; no task gets a hot key alone."""
    hot = values.where(F.col(count) > total / HOT)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(values.where(F.col(count) <= total / HOT), keys, "left")
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def _counted(mails: DataFrame) -> DataFrame:
    """(r, counts, sender_mails): for the lines of a mail that occur more than once (no, mails of the sender with it, mails, senders,
    mails that have it unquoted), and how many mails its sender has. A mail without a sender counts as one of its own sender."""
    posted = mails.select("r", "sender", F.posexplode(F.arrays_zip("lines", "norm")).alias("at", "x")).where(F.length("x.norm") > 2)
    own = F.coalesce(F.col("sender"), F.concat(F.lit("\0"), F.col("r").cast("string")))
    keyed = posted.select("r", (F.col("at") + 1).alias("no"), F.xxhash64("x.norm").alias("h"), F.xxhash64(own).alias("s"), F.col("x.lines").rlike(MARK).alias("q"))
    by_sender = saved(keyed.groupBy("h", "s").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(~F.col("q"), 1).otherwise(0)).alias("u")))
    by_line = by_sender.groupBy("h").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("senders"), F.sum("u").alias("unquoted")).where("all > 1")
    total = by_sender.agg(F.sum("n")).first()[0] or 0
    lines = _looked_up(keyed, by_line, ["h"], "all", total).where(F.col("all").isNotNull())
    lines = _looked_up(lines, by_sender.where("n > 1").select("h", "s", "n"), ["h", "s"], "n", total)
    sizes = mails.where(F.col("sender").isNotNull()).groupBy("sender").agg(F.count(F.lit(1)).alias("sender_mails"))
    senders = _looked_up(mails.where(F.col("sender").isNotNull()).select("r", "sender"), sizes, ["sender"], "sender_mails", mails.count())
    counts = lines.groupBy("r").agg(F.collect_list(F.struct("no", F.coalesce("n", F.lit(1)).alias("n"), "all", "senders", "unquoted")).alias("counts"))
    return senders.select("r", "sender_mails").join(counts, "r", "full")


def _counts(counts) -> dict[int, tuple[int, int, int, int]]:
    if counts is None or isinstance(counts, float):
        return {}
    return {int(c["no"]): (int(c["n"]), int(c["all"]), int(c["senders"]), int(c["unquoted"])) for c in counts}


def reply_subjects(df: DataFrame, record: str, subject: str) -> DataFrame:
    """The rows whose subject begins with a reply or forward mark, compared in canonical form; null subjects do not."""
    ship(df.sparkSession)

    @F.pandas_udf("boolean")
    def marked(subjects: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in subjects:
            yield s.map(is_reply_subject).astype(bool)

    return df.select(record, F.col(subject).alias("subject")).where(F.col("subject").contains(":") | F.col("subject").contains("：")).where(marked("subject"))


def blocks(lines: DataFrame, record: str) -> DataFrame:
    """(record, block, first_line, last_line, depth, other, probability): the blocks of each mail and their class."""
    return lines.groupBy(record, "block").agg(
        F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.max("depth").alias("depth"),
        F.first("other").alias("other"), F.first("probability").alias("probability"),
    )


def reduced(lines: DataFrame, record: str) -> DataFrame:
    """(record, new_text): the newly written lines of each mail in order; '' where nothing is new."""
    kept = F.collect_list(F.when(~F.col("other"), F.struct("line_no", "line")))
    return lines.groupBy(record).agg(F.array_join(F.transform(F.array_sort(kept), lambda x: x["line"]), "\n").alias("new_text"))
