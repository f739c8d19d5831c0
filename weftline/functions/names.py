"""What a column's name says about its values."""

from __future__ import annotations

import re
from dataclasses import dataclass


def joined(name: str) -> str:
    """Lower case, letters and digits only."""
    return re.sub(r"[^a-z0-9]", "", name.lower())


def tokens(name: str) -> list[str]:
    """The words of a snake, kebab or camel case name."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", name))
    return [w.lower() for w in re.split(r"[^A-Za-z0-9]+", spaced) if w]


@dataclass(frozen=True)
class Rule:
    """Matches if the joined name contains one of ``parts``, has a word of ``words``, or is one of ``exact``."""

    maker: str
    parts: tuple[str, ...] = ()
    words: tuple[str, ...] = ()
    exact: tuple[str, ...] = ()

    def matches(self, name: str) -> bool:
        whole = joined(name)
        return any(p in whole for p in self.parts) or whole in self.exact or not set(self.words).isdisjoint(tokens(name))


def rule(maker: str, parts: str = "", words: str = "", exact: str = "") -> Rule:
    return Rule(maker, *(tuple(x.split()) for x in (parts, words, exact)))


# Which names mean what. The first match wins.
TEXT_RULES = (
    rule("internet.email", "email"),
    rule("internet.username", "", "username login handle"),
    rule("internet.password", "password passwd pwd"),
    rule("person.firstName", "firstname givenname"),
    rule("person.lastName", "lastname surname familyname"),
    rule("person.middleName", "middlename"),
    rule("person.fullName", "fullname displayname"),
    rule("person.fullName", "contactname", "", "name"),
    rule("company.name", "company organization organisation employer"),
    rule("person.jobTitle", "jobtitle occupation", "position role"),
    rule("phone.number", "phone mobile", "cell fax"),
    rule("image.url", "avatar profilepic thumbnail", "photo picture image"),
    rule("internet.url", "website homepage"),
    rule("internet.userAgent", "useragent"),
    rule("internet.ipv4", "ipaddress ipaddr", "ip"),
    rule("internet.mac", "macaddress", "mac"),
    rule("internet.url", "", "url uri link href"),
    rule("lorem.slug", "permalink", "slug"),
    rule("location.street", "addressline streetaddress street"),
    rule("location.street", "", "address"),
    rule("location.city", "", "city town"),
    rule("location.state", "", "state province region"),
    rule("location.country", "", "country"),
    rule("location.zipCode", "zipcode postalcode postcode", "zip"),
    rule("location.latitude", "latitude", "lat"),
    rule("location.longitude", "longitude", "lng lon"),
    rule("location.timeZone", "timezone"),
    rule("finance.currencyCode", "", "currency"),
    rule("finance.iban", "", "iban"),
    rule("finance.creditCardNumber", "creditcard cardnumber"),
    rule("commerce.price", "price amount subtotal salary", "cost total balance fee"),
    rule("commerce.productName", "productname"),
    rule("commerce.product", "", "product"),
    rule("color.human", "color colour"),
    rule("lorem.sentence", "headline", "title subject"),
    rule("lorem.paragraph", "description", "summary bio about body content message comment text note notes"),
    rule("date.past", "firstseen createdat insertedat registeredat", "created"),
    rule("date.recent", "updatedat modifiedat lastseen lastlogin"),
    rule("date.future", "deletedat expiresat expiredat"),
    rule("date.birthdate", "birthdate dateofbirth birthday", "dob"),
    rule("person.sex", "", "gender sex"),
    rule("string.uuid", "", "uuid guid"),
)

#: Whole numbers by name: (parts, words, lowest, highest).
NUMBER_RULES = (
    (rule("age", "", "age"), 0, 95),
    (rule("year", "", "year"), 1970, 2025),
    (rule("quantity", "quantity", "qty"), 1, 100),
    (rule("rating", "", "rating stars"), 1, 5),
    (rule("score", "", "score points"), 0, 100),
    (rule("percentage", "percentage", "percent discount"), 0, 100),
    (rule("count", "", "count"), 0, 1000),
)
MONEY = rule("money", "price amount subtotal salary", "cost total balance fee")
MONEY_TOP = 10_000

# Which names mean what document. The first match wins.
JSON_RULES = (
    rule("address", "shippingaddress billingaddress", "address"),
    rule("point", "latlng", "coordinates coords geo location"),
    rule("tags", "", "tags labels keywords categories"),
    rule("permissions", "", "permissions scopes roles"),
    rule("settings", "", "settings preferences prefs config configuration options"),
    rule("dimensions", "dimensions", "size"),
    rule("contact", "", "contact"),
    rule("price", "pricing", "price money cost"),
    rule("profile", "", "profile"),
)


def text_rule(name: str) -> str | None:
    return next((r.maker for r in TEXT_RULES if r.matches(name)), None)


def number_rule(name: str) -> tuple[int, int] | str | None:
    """(lowest, highest), "money", or None."""
    for r, lo, hi in NUMBER_RULES:
        if r.matches(name):
            return lo, hi
    return "money" if MONEY.matches(name) else None


def json_rule(name: str) -> str:
    return next((r.maker for r in JSON_RULES if r.matches(name)), "record")
