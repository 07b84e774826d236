"""Made-up texts with known personal data, for training and testing the skip-chain field.

Each text holds things that the base patterns find and further mentions that they do not: numbers in other
ways of writing, mailbox names, people's names, credentials that come again without their key word. Among
them stand numbers and words of the same looks that are no personal data.
"""

from __future__ import annotations

import random

#: What stands before numbers and credentials in English, German, French and Spanish.
SECRET_WORDS = frozenset("token secret password passwd pwd apikey api_key api-key key access_key auth credential credentials bearer passwort kennwort contraseña clave jeton".split())
PHONE_WORDS = frozenset("call phone tel telephone mobile fax cell telefon anrufen ruf handy téléphone appelez portable llame teléfono móvil number nummer".split())
MAIL_WORDS = frozenset("mail email e-mail mailto write contact reach schreiben kontakt contactez escriba correo mailbox inbox".split())
CARD_WORDS = frozenset("card visa mastercard ending karte karten endet carte terminant tarjeta terminada".split())
HOST_WORDS = frozenset("ip host server address from login ping".split())
TITLE_WORDS = frozenset("mr mrs ms dr prof herr frau m mme señor señora dear liebe lieber by from signed regards".split())
#: Order of labels; 0 is no data.
LABELS = ("", "email", "ip", "card", "phone", "secret", "name")

_SYLLABLES = "ba co de fi gu la me no pi ra se ti vo wa zu ber den gal hin kor lin mar nes pol ran sul tor".split()
_FILLER = "the a of and to in that was for on with der die und das le la les et que el los para".split()


def _word(rng: random.Random, low: int = 2, high: int = 3) -> str:
    return "".join(rng.choice(_SYLLABLES) for _ in range(rng.randrange(low, high + 1)))


def _prose(rng: random.Random, n: int) -> list[str]:
    out = [rng.choice(_FILLER) if rng.random() < 0.4 else _word(rng) for _ in range(n)]
    return [w.capitalize() if not k or rng.random() < 0.15 else w for k, w in enumerate(out)]


def _digits(rng: random.Random, n: int) -> str:
    return str(rng.randrange(1, 10)) + "".join(rng.choice("0123456789") for _ in range(n - 1))


def _hex(rng: random.Random) -> str:
    return "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40, 40, 64])))


def _credential(rng: random.Random) -> str:
    if rng.random() < 0.6:
        return _hex(rng)
    letters = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789"
    return rng.choice(["", "sk-", "AK", "ghx_"]) + "".join(rng.choice(letters) for _ in range(rng.randrange(18, 40)))


def _luhn(rng: random.Random) -> str:
    body = _digits(rng, 15)
    total = sum((d * 2 - 9 if d * 2 > 9 else d * 2) if k % 2 == 0 else d for k, d in enumerate(map(int, reversed(body))))
    return body + str(-total % 10)


def example(rng: random.Random) -> tuple[str, list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """A text, its data (start, end, label), and those of them that the base patterns do not find."""
    parts: list[tuple[str, int, bool]] = []  # text, label, whether a base pattern finds it

    def say(low: int = 3, high: int = 12) -> None:
        parts.extend((w, 0, False) for w in _prose(rng, rng.randrange(low, high)))

    def put(text: str, label: int, base: bool = False) -> None:
        parts.append((text, label, base))

    say()
    for _ in range(rng.randrange(1, 4)):
        kind = rng.choice(["phone", "phone", "spoken", "mail", "mail", "name", "name", "secret", "secret", "secret", "card", "ip", "none", "none", "none"])
        cue = lambda words: put(rng.choice(sorted(words)) + rng.choice(["", "", ":"]), 0) if rng.random() < 0.6 else None
        if kind in ("phone", "spoken"):
            country, area, a, b = rng.choice(["1", "44", "49", "33"]), _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
            later = [f"{area}-{a}-{b}", f"({area}) {a}-{b}", f"0{area}/{a}{b}", f"{area}{a}{b}", f"{area} {a} {b}", f"{area}.{a}.{b}", f"{a}-{b}", f"00{country}{area}{a}{b}", f"{area} - {a} - {b}", f"tel:{area}-{a}-{b}", f"{country} {area} {a} {b}"]
            if kind == "phone":
                cue(PHONE_WORDS)
                put(rng.choice([f"+{country} {area} {a} {b}", f"+{country} ({area}) {a}-{b}", f"+{country}{area}{a}{b}"]), 4, True)
                for _ in range(rng.randrange(1, 3)):
                    say()
                    put(rng.choice(later), 4)
            else:
                put(rng.choice(["call", "phone:", "tel.", "Telefon", "fax:", "téléphone", "teléfono"]), 0)
                put(rng.choice(later[:3] + later[5:6]), 4)
        elif kind in ("mail", "name"):
            first, last = _word(rng, 1, 2), _word(rng, 2, 3)
            box = rng.choice([f"{first}.{last}", f"{first}_{last}", f"{first}-{last}"]) if kind == "name" or rng.random() < 0.6 else f"{last}.{rng.randrange(10, 99)}"
            host = f"{_word(rng)}.{rng.choice(['com', 'org', 'de', 'net'])}"
            mail, full = f"{box}@{host}", f"{first.capitalize()} {last.capitalize()}"
            named = kind == "name" and rng.random() < 0.5
            if named:
                put(full, 6)
                say(0, 3)
            cue(MAIL_WORDS)
            put(mail, 1, True)
            for _ in range(rng.randrange(1, 3)):
                say()
                if kind == "name":
                    put(rng.choice([full, full, f"{last.capitalize()}, {first.capitalize()}", f"{rng.choice(['Mr', 'Ms', 'Dr', 'Herr', 'Frau', 'Mme'])} {last.capitalize()}"]), 6)
                    if rng.random() < 0.3:  # the same words as plain words
                        say(2, 5)
                        put(rng.choice([first, last]), 0)
                else:
                    put(rng.choice([f"{box}@{host.partition('.')[0]}", f"{box} (at) {host}".split(" ")[0], f"{box}@"]), 1)
        elif kind == "secret":
            value, word = _credential(rng), rng.choice(sorted(SECRET_WORDS))
            if rng.random() < 0.7:
                put(word, 0)
                if rng.random() < 0.7:
                    put("=", 0)
                put(rng.choice(['"{}"', "'{}'", "{}"]).format(value), 5)
            else:
                put(f"{word}{rng.choice(['=', ':'])}{value}", 5)
            for _ in range(rng.randrange(0, 3)):
                say()
                put(rng.choice(["{}", "({})", "{},", '"{}"']).format(value), 5)
        elif kind == "card":
            d = _luhn(rng)
            cue(CARD_WORDS)
            put(rng.choice([d, f"{d[:4]} {d[4:8]} {d[8:12]} {d[12:]}", f"{d[:4]}-{d[4:8]}-{d[8:12]}-{d[12:]}"]), 3, True)
            say()
            put(rng.choice([f"{d[:4]}.{d[4:8]}.{d[8:12]}.{d[12:]}", f"****{d[12:]}", f"xxxx-{d[12:]}", f"**** {d[12:]}".split(" ")[0] + d[12:]]), 3)
        elif kind == "ip":
            n = [str(rng.randrange(1, 255)) for _ in range(4)]
            cue(HOST_WORDS)
            put(".".join(n), 2, True)
            say()
            put(rng.choice(["ip-" + "-".join(n), "-".join(n), "_".join(n)]), 2)
        else:
            value = _hex(rng)
            for _ in range(rng.randrange(1, 3)):  # no data, although some of it comes again
                put(rng.choice(["commit", "revision", "build", "sha1", "version", "order", "item", "in", "since"]), 0)
                put(rng.choice([value, value, str(rng.randrange(1900, 2030)), _digits(rng, rng.randrange(5, 14)), f"{rng.randrange(1, 9)}.{rng.randrange(9)}.{rng.randrange(30)}", f"{rng.randrange(1, 99)}.{rng.randrange(10, 99)}", f"20{rng.randrange(10, 30)}-0{rng.randrange(1, 10)}-{rng.randrange(10, 29)}", f"{rng.randrange(24)}:{rng.randrange(10, 60)}", f"@{_word(rng)}", f"{_word(rng)}-{rng.randrange(3, 90)}", f"{rng.randrange(2, 90)}%", f"https://{_word(rng)}.com/{_word(rng)}/{rng.randrange(10**6)}", f"#{rng.randrange(10**5)}", _digits(rng, 8) + "###"]), 0)
                say()
        say()
    text, spans, more = "", [], []
    for k, (part, label, base) in enumerate(parts):
        text += (" " if k and rng.random() > 0.03 else "\n" if k else "")
        if label:
            spans.append((len(text), len(text) + len(part), label))
            if not base:
                more.append(spans[-1])
        text += part + ("." if not label and part[-1:].isalpha() and rng.random() < 0.08 else "")
    return text, spans, more


def examples(n: int, seed: int) -> list[tuple[str, list, list]]:
    rng = random.Random(seed)
    return [example(rng) for _ in range(n)]
