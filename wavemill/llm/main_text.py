"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks (``html_blocks``). Each block becomes a vector: the sum of hashed vectors of the tags and
class words on its path, the mean of hashed vectors of its words, and a few measures (length, share of links, punctuation).
A bidirectional LSTM in numpy reads the whole sequence, so that every block is judged in the context of the whole page, and gives
the probability that the block is main text; blocks of at least ``THRESHOLD`` are joined in page order.

The model is trained where it is used. Its training pages are made: page layouts (menus, headers, notices, adverts, sidebars,
forms, comments, footers around and inside articles, with telling names, with others and with none) filled with the words of a
drawn sample of at most ``SAMPLE`` pages of at most ``SAMPLE_CHARS`` characters, and the sampled pages
themselves where an ``article`` or ``main`` element tells their main text. The sample bounds only what is learnt from; every page
is labelled whole. The fitted weights, a few MB whatever the input, are broadcast.

Cases: a null or empty html, or one without text, gives the empty text. Repeated rows each give a row. An empty table gives no
rows. Extra columns are ignored. Long pages are read in linear time; a page is one task's work.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm.common import small_batches
from wavemill.llm.html_blocks import Page, parse
from wavemill.llm.words import word_hashes

SAMPLE, SAMPLE_CHARS = 200, 50_000
#: Made training pages, passes over them, pages in a step.
MADE, EPOCHS, STEP_PAGES = 1500, 9, 24
THRESHOLD = 0.5
PATH_BUCKETS, PATH_DIM, WORD_BUCKETS, WORD_DIM, MEASURES, HIDDEN = 4096, 24, 8192, 10, 7, 16
#: Blocks labelled at once, about; a longer page goes by itself.
GROUP_BLOCKS = 1 << 14


# ---- vectors -----------------------------------------------------------------------------------------------------------


def _bucket(kind: str, name: str) -> int:
    return zlib.crc32(f"{kind}{name}".encode("utf-8", "surrogatepass")) % PATH_BUCKETS


class Batch:
    """Pages as flat arrays: nodes of the tag trees with their tokens, blocks with node, words and measures."""

    def __init__(self, pages: list[Page]) -> None:
        known: dict[tuple[str, str], int] = {}

        def ids(kind: str, names: tuple[str, ...]) -> list[int]:
            return [known[kind, n] if (kind, n) in known else known.setdefault((kind, n), _bucket(kind, n)) for n in names]

        self.lengths = np.array([len(p.texts) for p in pages], np.int64)
        parents, depths, tokens, owners, nodes, own, own_of = [], [], [], [], [], [], []
        for p in pages:
            first = len(parents)
            for parent, depth, names in zip(p.parents, p.depths, p.names):
                got = ids("above ", names)
                tokens += got
                owners += [len(parents)] * len(got)
                parents.append(first + parent)
                depths.append(depth)
            for node, inline in zip(p.nodes, p.inline):
                got = ids("leaf ", p.names[node]) + ids("inline ", inline)
                own += got
                own_of += [len(nodes)] * len(got)
                nodes.append(first + node)
        as_int = lambda x: np.array(x, np.int64)
        self.parents, depths = as_int(parents), as_int(depths)
        self.tokens, self.owners, self.nodes, self.own, self.own_of = map(as_int, (tokens, owners, nodes, own, own_of))
        order = np.argsort(depths, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depths))[:-1]) if len(depths) else []
        texts = [t for p in pages for t in p.texts]
        hashes, self.counts = word_hashes(texts)
        self.words = (hashes % np.uint64(WORD_BUCKETS)).astype(np.int64)
        self.word_of = np.repeat(np.arange(len(texts)), self.counts)
        self.measures = _measures(texts, [n for p in pages for n in p.link_chars], self.counts, depths[self.nodes] if texts else depths[:0])

    def vectors(self, m: dict[str, np.ndarray]) -> np.ndarray:
        path = np.zeros((len(self.parents), PATH_DIM))
        np.add.at(path, self.owners, m["path"][self.tokens])
        for level in self.levels[1:]:
            path[level] += path[self.parents[level]]
        leaf = path[self.nodes]
        np.add.at(leaf, self.own_of, m["path"][self.own])
        starts = np.cumsum(self.counts) - self.counts
        word = np.zeros((len(self.nodes), WORD_DIM))
        some = self.counts > 0
        if some.any():
            word[some] = np.add.reduceat(m["word"][self.words], starts[some]) / self.counts[some, None]
        return np.concatenate([leaf, word, self.measures], axis=1)

    def spread(self, d: np.ndarray, grads: dict[str, np.ndarray]) -> None:
        """Gradients of the vectors back to the hashed vectors."""
        leaf = d[:, :PATH_DIM]
        np.add.at(grads["path"], self.own, leaf[self.own_of])
        path = np.zeros((len(self.parents), PATH_DIM))
        np.add.at(path, self.nodes, leaf)
        for level in self.levels[:0:-1]:
            np.add.at(path, self.parents[level], path[level])
        np.add.at(grads["path"], self.tokens, path[self.owners])
        word = d[:, PATH_DIM : PATH_DIM + WORD_DIM] / np.maximum(1, self.counts)[:, None]
        np.add.at(grads["word"], self.words, word[self.word_of])


def _measures(texts: list[str], link_chars: list[int], n_words: np.ndarray, depths: np.ndarray) -> np.ndarray:
    chars = np.array([len(t) for t in texts], np.float64)
    marks = np.array([sum(map(t.count, ".,;:!?")) for t in texts], np.float64)
    return np.stack(
        [
            np.log1p(n_words) / 3, np.log1p(chars) / 5, np.minimum(1, np.array(link_chars) / np.maximum(1, chars)), np.minimum(1, 4 * marks / np.maximum(1, n_words)),
            np.array([t[-1:] in ".!?:" for t in texts], np.float64), np.log1p(depths) / 2, np.array(["©" in t for t in texts], np.float64),
        ], axis=1,
    ).reshape(len(texts), MEASURES)


# ---- the network -------------------------------------------------------------------------------------------------------


def _weights(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    size = PATH_DIM + WORD_DIM + MEASURES
    m = {"path": rng.normal(0, 0.1, (PATH_BUCKETS, PATH_DIM)), "word": rng.normal(0, 0.1, (WORD_BUCKETS, WORD_DIM))}
    for way in "fb":
        m[f"in_{way}"] = rng.normal(0, size**-0.5, (size, 4 * HIDDEN))
        m[f"back_{way}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
        m[f"bias_{way}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
    m["out"], m["out_bias"] = rng.normal(0, 0.2, 2 * HIDDEN), np.zeros(1)
    return m


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _read(m: dict, way: str, x: np.ndarray, there: np.ndarray, keep: list | None = None) -> np.ndarray:
    """One direction over (blocks, pages, vector); a page's state stands still where it has no block."""
    steps, pages, _ = x.shape
    h = c = np.zeros((pages, HIDDEN))
    out = np.zeros((steps, pages, HIDDEN))
    into = x @ m[f"in_{way}"] + m[f"bias_{way}"]
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        z = into[t] + h @ m[f"back_{way}"]
        gates, new = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        on = there[t][:, None]
        c_new = np.where(on, f * c + i * new, c)
        tc = np.tanh(c_new)
        h_new = np.where(on, o * tc, h)
        if keep is not None:
            keep.append((t, h, c, i, f, o, new, tc))
        h, c = h_new, c_new
        out[t] = h
    return out


def _read_back(m: dict, way: str, x: np.ndarray, there: np.ndarray, kept: list, d_out: np.ndarray, grads: dict) -> np.ndarray:
    d_in = np.zeros((*x.shape[:2], 4 * HIDDEN))
    dh = dc = np.zeros(d_out.shape[1:])
    for t, h, c, i, f, o, new, tc in reversed(kept):
        on = there[t][:, None]
        dh = dh + d_out[t]
        d_c = np.where(on, dc + dh * o * (1 - tc * tc), 0)
        dz = np.concatenate([d_c * new * i * (1 - i), d_c * c * f * (1 - f), np.where(on, dh * tc * o * (1 - o), 0), d_c * i * (1 - new * new)], axis=1)
        d_in[t] = dz
        grads[f"back_{way}"] += h.T @ dz
        dh = np.where(on, dz @ m[f"back_{way}"].T, dh)
        dc = np.where(on, d_c * f, dc)
    flat = d_in.reshape(-1, 4 * HIDDEN)
    grads[f"in_{way}"] += x.reshape(len(flat), -1).T @ flat
    grads[f"bias_{way}"] += flat.sum(0)
    return d_in @ m[f"in_{way}"].T


def _placed(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Step and page of each block, and which places hold one."""
    page = np.repeat(np.arange(len(lengths)), lengths)
    step = np.arange(len(page)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    there = np.arange(lengths.max(initial=0))[:, None] < lengths
    return step, page, there


def probabilities(m: dict[str, np.ndarray], batch: Batch) -> np.ndarray:
    """For each block of the batch the probability that it is main text."""
    step, page, there = _placed(batch.lengths)
    if not len(step):
        return np.zeros(0)
    x = np.zeros((*there.shape, PATH_DIM + WORD_DIM + MEASURES))
    x[step, page] = batch.vectors(m)
    h = np.concatenate([_read(m, way, x, there) for way in "fb"], axis=2)
    return _sigmoid(h[step, page] @ m["out"] + m["out_bias"])


def _gradients(m: dict, batch: Batch, labels: np.ndarray) -> tuple[float, dict]:
    step, page, there = _placed(batch.lengths)
    vectors = batch.vectors(m)
    x = np.zeros((*there.shape, vectors.shape[1]))
    x[step, page] = vectors
    kept = {way: [] for way in "fb"}
    h = np.concatenate([_read(m, way, x, there, kept[way]) for way in "fb"], axis=2)
    here = h[step, page]
    p = _sigmoid(here @ m["out"] + m["out_bias"])
    loss = -np.mean(np.log(np.where(labels == 1, p, 1 - p) + 1e-12))
    err = (p - labels) / len(labels)
    grads = {k: np.zeros_like(v) for k, v in m.items()}
    grads["out"], grads["out_bias"] = err @ here, np.array([err.sum()])
    dh = np.zeros_like(h)
    dh[step, page] = err[:, None] * m["out"]
    dx = sum(_read_back(m, way, x, there, kept[way], dh[:, :, k * HIDDEN : (k + 1) * HIDDEN], grads) for k, way in enumerate("fb"))
    batch.spread(dx[step, page], grads)
    return loss, grads


def train(pages: list[tuple[Page, list[int]]], seed: int = 7) -> dict[str, np.ndarray]:
    """Fit by Adam to pages with a label (1: main text) for each block."""
    pages = sorted((p for p in pages if p[1]), key=lambda p: len(p[1]))
    steps = [(Batch([p for p, _ in pages[k : k + STEP_PAGES]]), np.concatenate([y for _, y in pages[k : k + STEP_PAGES]])) for k in range(0, len(pages), STEP_PAGES)]
    m = _weights(seed)
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    rng, n = np.random.default_rng(seed), 0
    for epoch in range(EPOCHS):
        for k in rng.permutation(len(steps)):
            n += 1
            _, grads = _gradients(m, *steps[k])
            rate = 0.01 * (1 - epoch / EPOCHS) + 0.0005
            for name, g in grads.items():
                g += 1e-6 * m[name]
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.01 * (g * g - second[name])
                m[name] -= rate * (first[name] / (1 - 0.9**n)) / (np.sqrt(second[name] / (1 - 0.99**n)) + 1e-8)
    return m


# ---- training pages ----------------------------------------------------------------------------------------------------

# Names that page parts go by, as "tag" or "tag.class" or "tag#id".
PARTS = {
    "menu": "nav nav div.menu ul#nav div.navbar div#navigation ul.main-menu nav.breadcrumbs div.topnav div.pagination div.nav-links ol.breadcrumb div#menu ul.tabs",
    "header": "header header header header div.header div#header div.site-header div#masthead div.top-bar div.branding header.page-header div.logo",
    "notice": "div.cookie-notice div.notice div#cookie-banner div.alert div.consent div.gdpr section.announcement div.popup div.modal div.paywall aside.notice "
    "div.warning p.notice div.disclaimer dialog div.message div.info-box div.promo div.newsletter",
    "advert": "div.ad div.ads div.advert aside.ad div.advertisement div.sponsored div#banner ins.adsbygoogle div.ad-slot section.promoted div.sponsor p.ad figure.ad",
    "sidebar": "aside aside div.sidebar div#sidebar div.widget aside.related div.related-posts section.recommended div.most-read div.rail div#secondary section.teasers "
    "div.trending aside.author-box div.tags",
    "form": "form form.search form#subscribe div.search-form form.contact form.login fieldset div.signup",
    "comments": "section.comments div#comments ol.comment-list div.comments section#comments div.reader-comments div#disqus section.discussion div.replies ul.responses "
    "div.feedback section#respond aside.comments",
    "share": "div.share ul.social div.share-buttons div.social-links p.share",
    "footer": "footer footer div.footer div#footer div.site-footer div#colophon footer.page-footer div.copyright div.legal",
}
ARTICLES = (
    "article article main div#content div.post div.entry-content section.story div.article-body div.main-content article.post main#main div.text td section div "
    "div.content div#main div.page-content article.entry div.post-body"
).split()
COMMENT_ITEMS = "div.comment li.comment article.comment div.reply p.comment li div.comment-body blockquote.comment article".split()
INNER = "div div.text div.body div.column section div.wrapper div.inner".split()
SHORT = (
    "Home|About|Contact|Log in|Sign up|Subscribe|Share|Read more|Search|Menu|Next|Previous|Reply|Like|Terms of use|Privacy policy|All rights reserved.|Accept|"
    "Follow us|Advertisement|Related articles|Comments|Leave a comment|Your name|E-mail|Send|Kontakt|Impressum|Startseite|Suche|Anmelden|Accueil|Rechercher|"
    "Connexion|Inicio|Buscar|Contacto"
).split("|")
NOTICES = (
    "We use cookies to improve your experience.|Please accept our cookies to continue.|This site uses cookies.|Subscribe to our newsletter for weekly updates.|"
    "You have read your last free article this month.|Your browser is out of date.|Wir verwenden Cookies.|Ce site utilise des cookies.|Este sitio utiliza cookies."
).split("|")
_PLAIN_WORDS = "the of and to in is that for it was on are as with they be at one have this from".split()


def _element(rng: random.Random, name: str, hints: bool) -> tuple[str, str]:
    """Start and end tag; without hints a plain element of a name that says nothing."""
    tag, sep, word = name.partition("." if "." in name else "#")
    if not hints:
        tag, sep, word = "div", ".", "".join(rng.choices("abcdefghklmnoprstu", k=rng.randint(2, 6))) if rng.random() < 0.5 else ""
    attribute = f' {"class" if sep == "." else "id"}="{word}"' if word else ""
    return f"<{tag}{attribute}>", f"</{tag}>"


class Maker:
    """Pages of random layouts; each part gives html and the labels of its blocks."""

    def __init__(self, words: list[str], seed: int) -> None:
        self.rng = random.Random(seed)
        self.words = words if len(words) >= 50 else _PLAIN_WORDS

    def phrase(self, low: int, high: int) -> str:
        r, n = self.rng, self.rng.randint(low, high)
        at = r.randrange(max(1, len(self.words) - n))
        got = self.words[at : at + n] if len(self.words) > n else r.choices(self.words, k=n)
        return escape(" ".join(got), quote=False) or "a"

    def prose(self) -> str:
        r = self.rng
        long = r.random()
        text = self.phrase(1, 2) if long < 0.12 else self.phrase(1, 12) if long < 0.3 else self.phrase(10, 60) if long < 0.8 else self.phrase(60, 200)
        if r.random() < 0.06:
            text = escape(r.choice(SHORT + NOTICES))
        elif r.random() < 0.04:
            text = " | ".join(self.phrase(1, 2) for _ in range(r.randint(2, 6)))
        if r.random() < 0.3:
            tag = r.choice(["b", "em", "a href='/x'", "span", "strong", "code"])
            text = f"<{tag}>{text}</{tag.split()[0]}>" if r.random() < 0.3 else f"{text} <{tag}>{self.phrase(1, 4)}</{tag.split()[0]}> {self.phrase(1, 6)}"
        return text + ("." if r.random() < 0.7 else "") + ("<br>" if r.random() < 0.15 else "")

    def p(self, text: str) -> str:
        return self.rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>"]).format(text)

    def short(self) -> str:
        return escape(self.rng.choice(SHORT)) if self.rng.random() < 0.5 else self.phrase(1, 4)

    def links(self) -> tuple[str, int]:
        n = self.rng.randint(1, 8)
        item = self.rng.choice(["<li><a href='/{0}'>{0}</a></li>", "<div><a href='/{0}'>{0}</a></div>", "<p><a href='#'>{0}</a></p>", "<li>{0}"])
        return "".join(item.format(self.short()) for _ in range(n)), n

    def part(self, kind: str, hints: bool = True) -> tuple[str, list[int]]:
        r = self.rng
        start, end = _element(r, r.choice(PARTS[kind].split()), hints)
        inner, n = "", 0

        def add(html: str, count: int = 1) -> None:
            nonlocal inner, n
            inner += html
            n += count

        if kind in ("menu", "share"):
            html, count = self.links()
            add(f"<ul>{html}</ul>" if start.startswith("<div") and r.random() < 0.5 else html, count)
        elif kind == "header":
            if r.random() < 0.6:
                add(f"<{(t := r.choice(['h1', 'div', 'p', 'h2']))}>{self.phrase(1, 6)}</{t}>")
            if r.random() < 0.6 or not n:
                text = self.phrase(2, 12) if r.random() < 0.6 else self.phrase(10, 40)
                add(text if not n and r.random() < 0.5 else f"<p>{text}</p>")
            if r.random() < 0.4:
                html, count = self.part("menu", hints)
                add(html, len(count))
        elif kind in ("notice", "advert"):
            if start.startswith("<p"):
                add(self.phrase(2, 30))
            else:
                for _ in range(r.randint(1, 2)):
                    text = r.choice(NOTICES) if kind == "notice" and r.random() < 0.4 else self.phrase(2, 40)
                    add(f"<p>{text}</p>" if r.random() < 0.6 else f"<div>{text}</div>")
                if r.random() < 0.3:
                    add(f"<button>{self.short()}</button>")
            if r.random() < 0.4 and n == 1:
                inner = inner.replace("<p>", "").replace("</p>", "").replace("<div>", "").replace("</div>", "")
        elif kind == "sidebar":
            for _ in range(r.randint(1, 3)):
                if r.random() < 0.5:
                    add(f"<h3>{self.phrase(1, 5)}</h3>")
                if r.random() < 0.5:
                    html, count = self.links()
                    add(f"<ul>{html}</ul>", count)
                else:
                    add(f"<p>{self.phrase(4, 60)}</p>")
        elif kind == "form":
            for _ in range(r.randint(1, 3)):
                add(r.choice(["<p>{}</p>", "<div><label>{}</label><input name='q'></div>", "<button type='submit'>{}</button>", "<select><option>{}</option></select>", "<textarea>{}</textarea>"]).format(self.short() if r.random() < 0.5 else self.phrase(3, 40)))
        elif kind == "comments":
            if r.random() < 0.6:
                add(f"<h2>{r.choice(['Comments', 'Kommentare', 'Commentaires', self.phrase(1, 4)])}</h2>")
            item = r.choice(COMMENT_ITEMS)
            for _ in range(r.randint(1, 5)):
                s, e = _element(r, item, True)
                text = self.phrase(3, 60) if r.random() < 0.8 else self.phrase(60, 150)
                if s.startswith("<p") or r.random() < 0.4:
                    add(f"{s}{text}{e}")
                else:
                    who = r.random() < 0.5
                    add(f"{s}{f'<div>{self.phrase(1, 3)}</div>' if who else ''}<p>{text}</p>{e}", 1 + who)
            if r.random() < 0.3:
                html, count = self.part("form", hints)
                add(html, len(count))
        else:
            add(f"<p>&copy; {self.phrase(1, 12)}</p>" if r.random() < 0.5 else f"<div>&copy; {self.phrase(1, 12)} &middot; {self.phrase(1, 10)}</div>")
            if n == 1 and r.random() < 0.5:
                inner = inner.replace("<p>", "").replace("</p>", "").replace("<div>", "").replace("</div>", "")
            if r.random() < 0.4:
                html, count = self.links()
                add(f"<ul>{html}</ul>", count)
        return start + inner + end, [0] * n

    def article(self, hints: bool) -> tuple[str, list[int]]:
        r = self.rng
        start, end = _element(r, r.choice(ARTICLES), hints)
        if start.startswith("<td"):
            start, end = "<table><tr>" + start, end + "</tr></table>"
        if r.random() < 0.2:
            start, end = "<main>" + start, end + "</main>"
        if r.random() < 0.3:
            s, e = _element(r, r.choice(INNER), hints)
            start, end = start + s, e + end
        html, labels = start, []
        if r.random() < 0.8:
            title = f"<h1>{self.phrase(2, 14)}</h1>"
            html += f"<header>{title}</header>" if r.random() < 0.1 else title
            labels.append(1)
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 10, 20])):
            kind = r.random()
            if kind < 0.08:
                n, line = r.randint(2, 12), self.short() if r.random() < 0.5 else self.phrase(1, 12)
                html += "".join(f"<p>{line if r.random() < 0.8 else self.short()}</p>" for _ in range(n))
                labels += [1] * n
            elif kind < 0.62:
                html += self.p(self.prose())
                labels.append(1)
            elif kind < 0.70:
                html += f"<{(t := r.choice(['h2', 'h3', 'blockquote', 'pre', 'figcaption']))}>{self.phrase(2, 20)}</{t}>"
                labels.append(1)
            elif kind < 0.78:
                n, (s, e) = r.randint(1, 5), r.choice([("<ul>", "</ul>"), ("<ol>", "</ol>")])
                short = r.random() < 0.5
                html += s + "".join(f"<li>{self.phrase(1, 5) if short else self.prose()}</li>" for _ in range(n)) + e
                labels += [1] * n
            elif kind < 0.81:
                n = r.randint(1, 3)
                html += "<table>" + "".join(f"<tr><td>{self.phrase(1, 5)}</td><td>{self.phrase(1, 8)}</td></tr>" for _ in range(n)) + "</table>"
                labels += [1] * (2 * n)
            else:
                got, zeros = self.part(r.choice(["advert", "share", "notice", "form", "form", "sidebar"]))
                html += got
                labels += zeros
        if not any(labels):
            html += f"<p>{self.prose()}</p>"
            labels.append(1)
        if r.random() < 0.3:
            got, zeros = self.part(r.choice(["comments", "comments", "footer", "share", "form"]))
            html, labels = html + got, labels + zeros
        return html + end, labels

    def page(self) -> tuple[str, list[int]]:
        r = self.rng
        hints = r.random() < 0.85
        body, labels = "", []

        def add(got: tuple[str, list[int]]) -> None:
            nonlocal body
            body += got[0]
            labels.extend(got[1])

        body += f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{self.phrase(2, 12)}</title><style>p{{margin:0}}</style></head><body>"
        labels.append(0)
        wrap = _element(r, r.choice(INNER), hints) if r.random() < 0.3 else ("", "")
        for kind, share in (("notice", 0.3), ("header", 0.5), ("menu", 0.7), ("advert", 0.4), ("form", 0.2)):
            if r.random() < share:
                add(self.part(kind, hints))
        body += wrap[0]
        if r.random() < 0.3:
            add(self.part(r.choice(["sidebar", "advert", "menu"]), hints))
        add(self.article(hints))
        for kind, share in (("share", 0.2), ("advert", 0.2), ("comments", 0.4), ("sidebar", 0.4)):
            if r.random() < share:
                add(self.part(kind, hints or kind == "comments"))
        body += wrap[1]
        for kind, share in (("notice", 0.2), ("form", 0.2), ("menu", 0.2), ("footer", 0.8)):
            if r.random() < share:
                add(self.part(kind, hints))
        return body + ("</body></html>" if r.random() < 0.8 else ""), labels


_OTHER = frozenset(w for names in PARTS.values() for n in names.split() for w in (f"<{n.split('.')[0].split('#')[0]}>", n.replace("#", ".").partition(".")[2]) if w) - {
    "<div>", "<p>", "<ul>", "<ol>", "<section>", "<figure>", "<header>"
}


def told_labels(page: Page) -> list[int] | None:
    """Labels of a page that tells its main text by an article or main element; None where it doesn't."""
    inside = [False] * len(page.names)
    for k in range(1, len(page.names)):
        names = page.names[k]
        inside[k] = (inside[page.parents[k]] or bool({"<article>", "<main>"} & set(names))) and not _OTHER & set(names)
    labels = [int(inside[n]) for n in page.nodes]
    return labels if any(labels) and not all(labels) else None


def training_pages(html: list[str], made: int = MADE, seed: int = 11) -> list[tuple[Page, list[int]]]:
    told, words = [], []
    for h in html:
        page = parse(h)
        labels = told_labels(page)
        if labels is not None:
            told.append((page, labels))
        words += [w for t in page.texts for w in t.split()]
    maker, out = Maker(words, seed), []
    for _ in range(made):
        h, labels = maker.page()
        page = parse(h)
        if len(page.texts) == len(labels):
            out.append((page, labels))
    return told + out


# ---- the operator ------------------------------------------------------------------------------------------------------


def fit(pages: DataFrame) -> dict[str, np.ndarray]:
    """A model from the sampled pages; from plain words where there are none. A draw of about four times as many rows as are
    wanted, whatever the size of the table, is ordered by hash; so what reaches the driver doesn't grow with the partitions."""
    share = min(1.0, 4 * SAMPLE / max(1, pages.count()))
    sample = pages.sample(fraction=share, seed=7).where(F.length("html") <= SAMPLE_CHARS).orderBy(F.xxhash64("page_id", "url"), F.xxhash64("html")).select("html").limit(SAMPLE)
    return train(training_pages([r["html"] for r in sample.collect()]))


def texts_of(m: dict[str, np.ndarray], html: list[str | None]) -> list[str]:
    """The main text of each page."""
    out: list[str] = []
    pages: list[Page] = []

    def label() -> None:
        p = probabilities(m, Batch(pages))
        at = 0
        for page in pages:
            kept = p[at : at + len(page.texts)] >= THRESHOLD
            out.append("\n\n".join(t for t, k in zip(page.texts, kept) if k))
            at += len(page.texts)
        pages.clear()

    longest = 0
    for h in html:
        page = parse(h)
        longest = max(longest, len(page.texts))
        if pages and longest * (len(pages) + 1) > GROUP_BLOCKS:
            label()
            longest = len(page.texts)
        pages.append(page)
    if pages:
        label()
    return out


def extract(pages: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """page_id, url, text (main text, blocks joined by an empty line), n_chars of every page."""
    spark = pages.sparkSession
    small_batches(spark)
    weights = spark.sparkContext.broadcast(model or fit(pages))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(weights.value, batch.column("html").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in pages.select("page_id", "url").schema}
    return pages.select("page_id", "url", "html").mapInArrow(label, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
