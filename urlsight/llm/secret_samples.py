"""Generated training texts for the secret tagger: lines with and without secrets, labelled by construction.

A line is a pattern with slots in braces. Slots named in ``SECRETS`` are filled with a value that
is a secret, the others with harmless text. Lines lie between pieces of the given surroundings, so that
the tagger also learns what running text and other files look like.
"""

from __future__ import annotations

import base64
import random
import re
import string

Sample = tuple[bytes, list[tuple[int, int]]]

HEX = "0123456789abcdef"
ALNUM = string.ascii_letters + string.digits
BASE64 = ALNUM + "+/"

WITH_SECRET = r"""
{cue} = "{value}"
{cue}: {value}
"{cue}": "{value}",
'{cue}' => '{value}',
{CUE}={value}
export {CUE}="{value}"
--{cue} {value}
-{cue}={value} --host {host}
Authorization: Bearer {value}
curl -H "Authorization: token {value}" https://{host}/v1/{word}
curl -u {name}:{value} https://{host}/
{word}://{name}:{value}@{host}:{number}/{word}
mysql -u {name} --password={value} {word}
aws_secret_access_key = {base64_40}
AWS_SECRET_ACCESS_KEY={base64_40}
{word} {prefixed} {word}
{cue} = {prefixed}
remote: https://{prefixed}@{host}/{word}.git
{jwt}
id_token: {jwt}
-----BEGIN RSA PRIVATE KEY-----\n{key_lines}\n-----END RSA PRIVATE KEY-----
-----BEGIN OPENSSH PRIVATE KEY-----\n{key_lines}\n-----END OPENSSH PRIVATE KEY-----
the {cue} is {password}
my {cue} is {password} {word}
{cue}: {password}
{cue} = '{password}'
log in as {name} with {cue} {password}
user {name} {cue} {password} host {host}
DB_PASSWORD={password}
<{cue}>{password}</{cue}>
{cue} {hex}
https://{host}/{word}?{cue}={value}&{word}={number}
AccountKey={base64_pad};EndpointSuffix={host}
"""

HARMLESS = r"""
the {cue} must be at least {number} characters long
forgot your {cue}? {word} {word} {word}
your {cue} has expired, please choose another
{cue} rotation policy for {word} and {word}
a {cue} is needed to read {word}
{cue} = get_{word}("{word}")
{cue} = os.environ["{CUE}"]
{cue}: ********
{cue}: ${{CUE}}
{cue}: <your-{cue}>
{cue}s = tokenize({word})
{word} {uuid} {word}
id: {uuid}
commit {short_hex} by {name}
version {version}
{word}=={version}
{date} {time} INFO {word}.{word} {number} {word}
{date}T{time}Z {word}: {word}
https://{host}/{word}/{word}-{number}.html
https://{host}/{word}?id={number}&page={number}
/usr/lib/{word}/{word}-{version}/{word}.so.{number}
{name}@{host} wrote {word}
call +{number}-{number}-{number} or {number} {number}
for (int {word} = 0; {word} < {number}; {word}++) {
def {word}_{word}({word}, {word}={number}):
return {word}.{camel}({camel}, "{word}")
MAX_{CUE}_LENGTH = {number}
color: #{color}; width: {number}px
{ip} - - [{date}] "GET /{word} HTTP/1.1" 200 {number}
ISBN {number}-{number}-{number}
${number}.{number} for {word}
import {word}.{word}.{camel}
{word}: {word}
"{word}": "{word}",
{word} = {number}
{CUE} {CUE} {word}
| {word} | {word} | {number} |
"""

CUES = (
    "password passwd pwd secret token api_key apikey api-key access_token auth_token client_secret private_key "
    "passphrase pass credentials secret_key app_secret db_password pin webhook_secret signing_key"
).split()
PREFIXES = {"ghp_": 36, "gho_": 36, "sk_live_": 24, "rk_live_": 24, "sk-": 48, "xoxb-": 40, "AIza": 35, "glpat-": 20,
            "npm_": 36, "SG.": 40, "hf_": 34, "dop_v1_": 64, "AKIA": 16, "EAAC": 60, "pypi-": 80}
SECRETS = frozenset({"value", "base64_40", "base64_pad", "prefixed", "jwt", "key_lines", "password", "hex"})
SLOT = re.compile(r"\{([a-z0-9_]+|CUE)\}", re.IGNORECASE)


class Filler:
    """Values for slots, drawn from one seeded source."""

    def __init__(self, draw: random.Random, words: list[str]):
        self.draw, self.words = draw, words

    def text(self, letters: str, low: int, high: int | None = None) -> str:
        return "".join(self.draw.choices(letters, k=self.draw.randint(low, high or low)))

    def word(self) -> str:
        return self.draw.choice(self.words)

    def cue(self) -> str:
        return self.draw.choice(CUES)

    def CUE(self) -> str:  # noqa: N802
        return self.cue().replace("-", "_").upper()

    def value(self) -> str:
        kind = self.draw.randrange(6)
        if kind == 0:
            return self.hex()
        if kind == 1:
            return self.password()
        if kind == 2:
            return self.text(BASE64, 16, 60)
        if kind == 3:
            return self.text(string.ascii_lowercase + string.digits, 10, 32)
        if kind == 4:
            return self.text(ALNUM + "-_", 16, 50)
        return self.text(ALNUM, 10, 44)

    def hex(self) -> str:
        return self.text(HEX, self.draw.choice((16, 24, 32, 40, 64)))

    def base64_40(self) -> str:
        return self.text(BASE64, 40)

    def base64_pad(self) -> str:
        return base64.b64encode(self.draw.randbytes(self.draw.choice((32, 40, 64)))).decode().rstrip("=")

    def prefixed(self) -> str:
        prefix = self.draw.choice(list(PREFIXES))
        return prefix + self.text(string.ascii_uppercase + string.digits if prefix == "AKIA" else ALNUM, PREFIXES[prefix])

    def jwt(self) -> str:
        return f"eyJ{self.text(ALNUM, 20, 40)}.eyJ{self.text(ALNUM, 30, 90)}.{self.text(ALNUM + '-_', 43)}"

    def key_lines(self) -> str:
        return "\n".join(self.text(BASE64, 64) for _ in range(self.draw.randint(1, 4)))

    def password(self) -> str:
        word = self.text(string.ascii_lowercase, 4, 8)
        if self.draw.random() < 0.5:
            word = word.capitalize()
        ending = self.draw.choice(("{}{}", "{}!{}", "{}_{}", "{}${}", "{}-{}#", "{}{}!"))
        return ending.format(word, self.text(string.digits, 1, 4))

    def name(self) -> str:
        return self.draw.choice(("root", "admin", "alice", "deploy", "bob.smith", "svc_user", "postgres"))

    def host(self) -> str:
        return f"{self.text(string.ascii_lowercase, 3, 9)}.{self.draw.choice(('example.com', 'internal', 'org', 'io', 'net'))}"

    def number(self) -> str:
        return self.text("123456789", 1, 6)

    def version(self) -> str:
        return ".".join(self.text(string.digits, 1, 2) for _ in range(3)) + self.draw.choice(("", "-beta", "rc1", "-rc.2"))

    def uuid(self) -> str:
        return "-".join(self.text(HEX, k) for k in (8, 4, 4, 4, 12))

    def short_hex(self) -> str:
        return self.text(HEX, 7, 12)

    def date(self) -> str:
        return f"20{self.text(string.digits, 2)}-0{self.draw.randint(1, 9)}-{self.draw.randint(10, 28)}"

    def time(self) -> str:
        return f"{self.draw.randint(10, 23)}:{self.draw.randint(10, 59)}:{self.draw.randint(10, 59)}"

    def color(self) -> str:
        return self.text(HEX, 6)

    def ip(self) -> str:
        return ".".join(str(self.draw.randrange(256)) for _ in range(4))

    def camel(self) -> str:
        return self.draw.choice(("read", "make", "find")) + "".join(self.text(string.ascii_lowercase, 3, 8).capitalize() for _ in range(2))


def filled(pattern: str, fill: Filler) -> tuple[str, list[tuple[int, int]]]:
    """A line and the places of its secrets."""
    line, spans, done = "", [], 0
    for slot in SLOT.finditer(pattern):
        line += pattern[done: slot.start()]
        value = getattr(fill, slot.group(1))()
        if slot.group(1) in SECRETS:
            spans.append((len(line), len(line) + len(value)))
        line, done = line + value, slot.end()
    return line + pattern[done:], spans


def lines(block: str) -> list[str]:
    return [line.replace("\\n", "\n") for line in block.strip().split("\n")]


def generated(count: int, seed: int, surroundings: tuple[bytes, ...] = ()) -> list[Sample]:
    """``count`` texts of a few lines between pieces of the surroundings, the same for a seed."""
    draw = random.Random(seed)
    pool = [t.decode("utf-8", "replace").split(" ") for t in surroundings]
    pool = [words for words in pool if len(words) > 3]
    words = sorted({w for t in pool for w in t if w.isalpha() and len(w) < 15})[:5000]
    words = words + "the of and value name file user data list index result config server request table main test".split()
    fill = Filler(draw, words)
    secret, harmless = lines(WITH_SECRET), lines(HARMLESS)
    out = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(draw.randint(1, 4)):
            if pool and draw.random() < 0.5:
                near = draw.choice(pool)
                low = draw.randrange(len(near))
                # The surroundings' own secrets would go unlabelled here.
                text += " ".join(w for w in near[low: low + draw.randint(2, 25)] if w.isalpha()) + draw.choice((" ", "\n"))
            line, inside = filled(draw.choice(secret if draw.random() < 0.45 else harmless), fill)
            begin = len(text)
            text += line + draw.choice(("\n", "\n", " ", ".\n", "\n\n"))
            spans += [(begin + a, begin + b) for a, b in inside]
        starts = [len(text[:a].encode()) for a, _ in spans]
        ends = [len(text[:b].encode()) for _, b in spans]
        out.append((text.encode(), list(zip(starts, ends))))
    return out
