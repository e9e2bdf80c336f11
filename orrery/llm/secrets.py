"""Secrets in text: fixed patterns, and strings too novel to be language.

Base spans are the matches of three patterns. The method adds to them: a candidate near a word such
as `password` or `token` is compressed with zstandard after its own surroundings, primed with a
dictionary of long words, of identifiers and of the surroundings; the bytes that it adds are what neither the code
around it nor common names explain. A word
counts on either side, and for all candidates of a block that only blanks and marks divide.
Copies of the candidate are no part of its surroundings.
Candidates that stay almost incompressible are reported as `novel`. The time for a text is in proportion to its
length: of a very long candidate with many sensitive words in it, the parts behind them are tried at growing
distances from its end.

Defined results: a null text counts as empty and has no spans; repeated rows and null ids are rows
like others; extra columns are kept by `scan`, and those named like its own outputs are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Words that make a context sensitive, and how many characters before or after a candidate they count.
SENSITIVE = re.compile(r"passw|passphrase|secret|token|api.?key|credential|auth|bearer|private.?key|access.?key|signature|client.?id|login", re.I | re.A)
SENSITIVE_WORDS = ("passw", "passphrase", "secret", "token", "key", "credential", "auth", "bearer", "signature", "client", "login")
REACH = 48
CANDIDATE, LEAST = re.compile(r"[A-Za-z0-9+/_=-]{12,}"), 12
#: What may stand between candidates of one block, such as the lines of a key: no letter, no digit.
GAP = re.compile(r"(?:\\[rnt]|[\W_])*")
#: Characters on either side that count as surroundings, and from a candidate's end within which a secret may
#: begin behind any sensitive word.
AROUND, NEAR = 512, 512
JOINTS = "+/_=-"
#: Added bytes for each character, and altogether, from which a candidate is incompressible.
NOVEL_RATE, NOVEL_BYTES = 0.6, 10
#: The identifier dictionary. Fixed value.
IDENTIFIERS = (
    "public static void private protected class function return import from def self this null true false none string int long double boolean byte char array list map set dict object value key name type "
    "user username password passwd secret token api_key apikey access_key client_id client_secret auth authorization bearer credential login session cookie header request response url http https host port path file "
    "config settings environment default example test sample placeholder changeme your_token_here database connection driver server service account region bucket endpoint version index count size length offset "
    "buffer stream reader writer encode decode parse format print log error warning debug info exception handler callback async await promise result data payload message query select insert update delete where join "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 000000000000 111111111111 xxxxxxxxxxxx XXXXXXXXXXXX ------------ ============ ____________ "
).encode()
#: Long words and their parts, so that words of a language cost little. Fixed value.
WORDS = (
    "authentication authorization authenticated authenticate authorisation unauthorized certificates certification cryptography cryptographic confidential confidentiality verification identification "
    "documentation documented implementation implementations implementing configuration configurations configurable administration administrator administrative infrastructure initialization functionality "
    "communication communications organization organisation organizations international internationalisation internationalization nationalisation representation representative representing distribution distributed "
    "compatibility incompatible responsibility responsibilities availability accessibility possibilities probabilities straightforward straightforwardly automatically specifically particularly approximately "
    "independently unfortunately significantly additionally respectively consequently subsequently simultaneously alternatively immediately successfully unsuccessful appropriately individually unconditionally "
    "requirements dependencies specification specifications classification notification modification registration transformation combinations applications recommendation consideration considerations "
    "understanding relationship relationships characteristic characteristics circumstances environment environments environmental development developments government governments manufacturing engineering "
    "introduction construction reconstruction instructions restrictions substitution contribution contributions subscription description descriptions prescription transmission acknowledgment correspondence "
    "professional professionals traditional conventional experimental mathematical philosophical psychological technological technologies architecture agricultural intellectual constitutional unprecedented "
    "extraordinary revolutionary comprehensive sophisticated corresponding distinguished neighbourhood approximation interpretation investigation investigations participation participants presentation "
    "concentration demonstration determination discrimination examination explanation generalization normalization optimization serialization synchronization asynchronous visualization localization "
    "entertainment establishment advertisement announcement improvements disappointment accomplishment intermediate preliminary deterministic heterogeneous multiprocessing preprocessing troubleshooting "
    "effectiveness consciousness nevertheless independence intelligence significance interference circumference measurements temperatures transactions transportation translations university "
    "Authentifizierung Verschluesselung Verschlüsselung Benutzername Zugangsdaten Verantwortung Gesellschaft gesellschaftlich Wissenschaft wissenschaftlich Wirtschaft wirtschaftlich Entwicklung Geschwindigkeit "
    "Möglichkeit Möglichkeiten Schwierigkeiten Zusammenarbeit Zusammenhang Unternehmen Unterstützung Veranstaltung Veröffentlichung Verwaltung Bundesrepublik Deutschland Regierung Vereinigten Staaten beziehungsweise "
    "selbstverständlich ausschließlich unterschiedlich wahrscheinlich verschiedene entsprechend grundsätzlich Voraussetzung Auseinandersetzung Grundstück Versicherung Arbeitgeber Arbeitnehmer Krankenhaus Öffentlichkeit "
    "authentification identifiant développement gouvernement environnement fonctionnement établissement enseignement renseignements administration particulièrement généralement immédiatement malheureusement "
    "automatiquement actuellement essentiellement représentation connaissance connaissances caractéristiques responsabilité compréhension internationale professionnelle économique scientifique politique République "
    "autenticación identificación contraseña administración desarrollo conocimiento funcionamiento establecimiento acontecimientos responsabilidad posibilidad características particularmente generalmente "
    "inmediatamente desafortunadamente especialmente aproximadamente representación comunicación organización investigación internacional profesionales universidad naturaleza sin embargo "
).encode()


class Novelty:
    def __init__(self) -> None:
        import zstandard

        self.zstandard = zstandard

    def added(self, before: str, candidate: str, after: str) -> int:
        """Bytes that the candidate adds to its surroundings, compressed with the dictionaries."""
        around = f"{before}\n{after}\n".encode("utf-8", "surrogatepass")
        primed = self.zstandard.ZstdCompressionDict(WORDS + IDENTIFIERS + around, dict_type=self.zstandard.DICT_TYPE_RAWCONTENT)
        press = self.zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_dict_id=False)
        context = before[-REACH:].encode("utf-8", "surrogatepass")
        return len(press.compress(context + candidate.encode())) - len(press.compress(context))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns, in order."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def copies(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Other occurrences of text[start:end] that reach into its surroundings: of the string without
    joints at its ends, of what stands between its equals signs, and of strings that are a part of it."""
    candidate = text[start:end]
    core = candidate.strip(JOINTS) or candidate
    parts = {core} | {p for p in candidate.split("=") if len(p) >= LEAST}
    found = []
    for edge, far in ((start - AROUND, start), (end, end + AROUND)):
        for part in parts:
            low, high = (max(0, edge - len(part) + 1), far) if far == start else (edge, far + len(part) - 1)
            at = text.find(part, low, high)
            while at >= 0:
                found.append((at, at + len(part)))
                at = text.find(part, at + len(part), high)
        for m in CANDIDATE.finditer(text, max(0, edge), far):
            inner = m[0].strip(JOINTS)
            if len(inner) >= LEAST and inner in candidate:
                found.append(m.span())
    return [(a, b) for a, b in found if b > start - AROUND and a < end + AROUND]


def surroundings(text: str, start: int, end: int) -> tuple[str, str]:
    """Before and after, with copies of the string blanked out: a secret must not explain itself."""
    low, high = max(0, start - AROUND), end + AROUND
    others = copies(text, start, end)
    if not others:
        return text[low:start], text[end:high]
    before, after = list(text[low:start]), list(text[end:high])
    for a, b in others:
        for side, first in ((before, low), (after, end)):
            for k in range(max(0, a - first), min(len(side), b - first)):
                side[k] = " "
    return "".join(before), "".join(after)


def candidates(text: str, words: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Strings of candidates' characters, cut at the sensitive words that stand apart in them."""
    k = 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while k < len(words) and words[k][1] <= start:
            k += 1
        while k < len(words) and words[k][1] <= end:
            low, high = words[k]
            apart = low <= start or text[low - 1] in JOINTS or high == end or text[high] in JOINTS
            if apart:
                if low - start >= LEAST:
                    yield start, low
                start = high
            k += 1
        if end - start >= LEAST:
            yield start, end


def tried(text: str, start: int, end: int) -> list[int]:
    """Where a secret may begin in a candidate: at its start, or behind a sensitive word grown into it.

    Beyond NEAR characters from the end, places are tried that are at least an eighth further from it than
    the one before, so that all that is compressed for a candidate is a few times its length."""
    behind, out = [m.end() for m in SENSITIVE.finditer(text, start, end) if end - m.end() >= LEAST], []
    for at in reversed(behind):
        if end - at <= NEAR or not out or (end - at) * 8 >= (end - out[-1]) * 9:
            out.append(at)
    return [start, *reversed(out)]


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    low = text.lower()
    if not any(w in low for w in SENSITIVE_WORDS):
        return []
    words = [m.span() for m in SENSITIVE.finditer(text)]
    if not words:
        return []
    out, block, near = [], [], False
    starts, furthest = [s for s, _, _ in base], list(accumulate((e for *_, e in base), max))

    def overlaps(start: int, end: int) -> bool:
        before = bisect_left(starts, end)  # base spans that start before the end
        return before > 0 and furthest[before - 1] > start

    def measure() -> None:
        for start, end in block:
            for at in tried(text, start, end):
                if not overlaps(at, end):
                    before, after = surroundings(text, at, end)
                    if novelty.added(before, text[at:end], after) >= max(NOVEL_BYTES, NOVEL_RATE * (end - at)):
                        out.append((at, 3, end))
                        break

    first = 0
    for start, end in candidates(text, words):
        if block and not GAP.fullmatch(text, block[-1][1], start):
            if near:
                measure()
            block, near = [], False
        block.append((start, end))
        while first < len(words) and words[first][1] < start - REACH:
            first += 1
        near = near or first < len(words) and words[first][0] <= end + REACH
    if near:
        measure()
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def scan(docs: DataFrame) -> DataFrame:
    """docs with n_assign, n_access, n_hex, n_novel, base_spans and spans (kind:start:end in code
    points, end exclusive, by start and kind, comma-joined)."""
    prepare(docs.sparkSession)
    outputs = ["n_assign", "n_access", "n_hex", "n_novel", "base_spans", "spans"]
    kept = [c for c in docs.columns if c not in outputs]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in source:
            rows = []
            for text in batch["text"].to_pylist():
                base = base_spans(text or "")
                new = novel_spans(text or "", base, novelty)
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), len(new), written(base), written(base + new)))
            if rows:
                columns = [pa.array(c, pa.int64() if k < 4 else pa.string()) for k, c in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *columns], names=[*kept, *outputs])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept] + [f"{c} long" for c in outputs[:4]] + [f"{c} string" for c in outputs[4:]]
    return docs.select(*kept).mapInArrow(run, ", ".join(fields))

