"""Built-in detectors of sensitive data."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


@dataclass(frozen=True)
class Detector:
    """One sensitive data type.

    Identifier patterns are case-insensitive whole words; literal patterns are used as they are.
    """

    id: str
    category: str
    data_type: str
    severity: str = ""
    identifier_patterns: tuple[str, ...] = ()
    literal_patterns: tuple[str, ...] = ()

    @property
    def effective_severity(self) -> str:
        s = self.severity.strip().upper()
        return s if s in SEVERITIES else "MEDIUM"


# Detector ids, labels, severities and patterns.  One block per detector: the
# header line, then identifier patterns (id) and literal patterns (lit).
_DETECTOR_TEXT = r"""
DATA-EMAIL | Personal Data | Email Address | MEDIUM
id e?_?mail(?:_?address)?
id user_?email
id contact_?email
id recipient_?email
id sender_?email
id from_?email
id to_?email
lit [A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}

DATA-PHONE-NUMBER | Personal Data | Phone Number | MEDIUM
id phone(?:_?number)?
id mobile(?:_?number)?
id tel(?:ephone)?(?:_?number)?
id cell(?:_?phone)?
id fax(?:_?number)?

DATA-PERSON-NAME | Personal Data | Person Name | MEDIUM
id first_?name
id last_?name
id middle_?name
id full_?name
id given_?name
id family_?name
id maiden_?name
id surname
id display_?name

DATA-POSTAL-ADDRESS | Personal Data | Postal Address | MEDIUM
id street_?address
id mailing_?address
id billing_?address
id shipping_?address
id home_?address
id postal_?address
id zip_?code
id postal_?code
id address_?line[_-]?\d?

DATA-DATE-OF-BIRTH | Personal Data | Date of Birth | HIGH
id date_?of_?birth
id birth_?date
id birthday
id dob

DATA-GENDER | Personal Data | Gender | MEDIUM
id gender
id pronouns

DATA-NATIONALITY | Personal Data | Nationality | MEDIUM
id nationality
id citizenship
id country_?of_?origin

DATA-GEOLOCATION | Personal Data | Geolocation | HIGH
id latitude
id longitude
id geo_?location
id gps_?coordinates?
id lat_?long

DATA-SSN | Personal Data | Social Security Number | CRITICAL
id ssn
id social_?security(?:_?number)?
id tax_?id
id national_?id
id itin
lit \b\d{3}-\d{2}-\d{4}\b

DATA-PASSPORT-NUMBER | Personal Data | Passport Number | CRITICAL
id passport(?:_?number)?
id passport_?no

DATA-DRIVERS-LICENSE | Personal Data | Drivers License | HIGH
id drivers?_?license(?:_?number)?
id driving_?license(?:_?number)?
id license_?number

DATA-CREDIT-CARD | Financial | Credit Card Number | CRITICAL
id credit_?card(?:_?number)?
id card_?number
id cc_?number
id primary_?account_?number
lit \b(?:4\d{12}(?:\d{3})?|5[1-5]\d{14}|3[47]\d{13}|6011\d{12}|(?:2131|1800|35\d{3})\d{11})\b

DATA-CVV | Financial | Card Verification Value | CRITICAL
id cvv\d?
id cvc\d?
id csc
id card_?security_?code
id card_?verification_?(?:value|code)

DATA-IBAN | Financial | Bank Account / IBAN | HIGH
id iban
id bank_?account(?:_?number)?
id account_?number
id routing_?number
id swift_?code
id bic
lit \b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b

DATA-HEALTH | Health | Health / Medical Data | CRITICAL
id medical_?record(?:_?number)?
id patient_?id
id diagnosis
id prescription
id health_?insurance(?:_?number)?
id blood_?type
id disability

DATA-PASSWORD | Authentication | Password | HIGH
id password
id passwd
id pwd
id passphrase
id secret_?phrase

DATA-API-TOKEN | Authentication | API Token / Key | HIGH
id api_?key
id api_?token
id access_?token
id refresh_?token
id auth_?token
id bearer_?token
id session_?token
id client_?secret
id private_?key

DATA-JWT | Authentication | JSON Web Token | HIGH
id jwt(?:_?token)?
id id_?token
lit \beyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\b

DATA-IP-ADDRESS | Technical | IP Address | LOW
id ip_?address
id client_?ip
id remote_?ip
id source_?ip
id peer_?ip
lit \b(?:25[0-5]|2[0-4]\d|[01]?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|[01]?\d?\d)){3}\b

DATA-MAC-ADDRESS | Technical | MAC Address | LOW
id mac_?address
lit \b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b

DATA-DEVICE-ID | Technical | Device Identifier | LOW
id device_?id
id device_?identifier
id udid
id imei
id advertising_?id
id idfa
id aaid
"""

# Cheap necessary conditions of the literal patterns above, by detector: substrings of which one
# must occur, a regex, and whether the text must have two digits close together.
LITERAL_GUARDS = {
    "DATA-EMAIL": (("@",), "", False),
    "DATA-SSN": (("-",), r"\d{3}-\d{2}-", True),
    "DATA-CREDIT-CARD": ((), r"\d{13}", True),
    "DATA-IBAN": ((), r"[A-Z]{2}\d{2}[A-Z0-9]{11}", True),
    "DATA-JWT": (("eyJ",), "", False),
    "DATA-IP-ADDRESS": ((".",), r"\d\.\d{1,3}\.\d", True),
    "DATA-MAC-ADDRESS": ((":", "-"), r"[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]", False),
}


def builtin_detectors() -> list[Detector]:
    out = []
    for block in _DETECTOR_TEXT.strip().split("\n\n"):
        head, *patterns = block.strip().splitlines()
        did, category, data_type, severity = (x.strip() for x in head.split("|"))
        out.append(
            Detector(
                did, category, data_type, severity,
                tuple(p[3:] for p in patterns if p.startswith("id ")),
                tuple(p[4:] for p in patterns if p.startswith("lit ")),
            )
        )
    return out


def expand_words(pattern: str) -> list[str] | None:
    """All words an identifier pattern can match, or None when it is not one plain ASCII word.

    Understands literals, ``x?``, ``(?:a|b)``, ``(?:a)?`` and ``\\d?``.
    """
    pos = 0

    def alternatives(until: str) -> list[str] | None:
        nonlocal pos
        done: list[str] = []
        current = [""]
        while pos < len(pattern) and pattern[pos] != until:
            ch = pattern[pos]
            if ch == "|":
                done += current
                current = [""]
                pos += 1
                continue
            if pattern.startswith("(?:", pos):
                pos += 3
                unit = alternatives(")")
                pos += 1
            elif pattern.startswith(r"\d", pos):
                unit = list("0123456789")
                pos += 2
            elif re.match(r"[A-Za-z0-9_]", ch):
                unit = [ch]
                pos += 1
            else:
                return None
            if unit is None:
                return None
            if pos < len(pattern) and pattern[pos] == "?":
                unit = unit + [""]
                pos += 1
            current = [a + b for a, b in product(current, unit)]
        return done + current

    words = alternatives("")
    return None if words is None else sorted(set(words))
