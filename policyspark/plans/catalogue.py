"""The template catalogue: which clauses an agreement has, what they say and which rule they make.

Placeholders: {P} provider, {R} recipient, {D} data, {U} purpose, {days}, {hours}, {notice}, {delay}.
A condition is (field, operator, JSON value); values may hold placeholders.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# The flags of an agreement, in order.
FLAGS = "read purpose_limit sharing_limit consent_exception confidentiality secure_storage deletion notification encryption storage_limit legal_disclosure legal_retention competition_limit platform_access records_access background_access publication authorized_access no_reidentification attribution error_reporting deletion_certificate provider_delivery".split()


@dataclass(frozen=True)
class Clause:
    number: str
    text: str
    flags: tuple[str, ...] = ()  # any of them; none: always there
    kind: str = ""
    action: str = ""
    asset: str = "Data"
    actor: str = "Recipient"
    when: tuple[tuple[str, str, str], ...] = ()
    relevant: bool = False
    heading: bool = False
    scope: int = 0
    extra: dict[str, tuple[str, str, str]] = field(default_factory=dict, hash=False)  # by flag: one more condition


def _head(number: str, text: str, *flags: str, scope: int = 0) -> Clause:
    return Clause(number, text, flags, heading=True, scope=scope)


def _rule(number: str, flag: str, kind: str, action: str, text: str, *when: tuple[str, str, str], asset: str = "Data", actor: str = "Recipient", extra: dict | None = None) -> Clause:
    return Clause(number, text, (flag,), kind, action, asset, actor, when, True, extra=extra or {})


CATALOGUE = [
    _head("1", "Who and what"),
    Clause("1.1", 'Provider means the house of {P}.', relevant=True),
    Clause("1.2", 'Recipient means the house of {R}.', relevant=True),
    Clause("1.3", 'Data means the collection named {D}.', relevant=True),
    Clause("1.4", 'Purpose means {U}.', relevant=True),
    Clause("1.5", 'Parties means Provider and Recipient together.'),
    Clause("1.6", 'Incident means a loss of Data or an access to Data that nobody allowed.', ("notification",), relevant=True),
    Clause("1.7", 'Platform means the portal of Provider.', ("platform_access",), relevant=True),
    _head("2", "Working together"),
    Clause("2.1", "The two sides pursue Purpose as clause 3.1 allows and Annex A details.", relevant=True),
    Clause("2.2", "Each side pays for its own staff."),
    _head("3", "Use of the material", "read", "purpose_limit", "sharing_limit", "competition_limit"),
    _rule("3.1", "read", "permission", "read", "Recipient may read Data for {U}.", ("purpose", "eq", '"{U}"')),
    _rule("3.2", "purpose_limit", "prohibition", "use", "Recipient must not use Data for anything other than {U}.", ("purpose", "neq", '"{U}"')),
    _rule("3.3", "sharing_limit", "prohibition", "share", "Recipient must not share Data with any third party, subject to clauses 3.1 and 4.1.", ("recipient", "eq", '"third party"'), extra={"consent_exception": ("approval", "neq", '"written consent"'), "legal_disclosure": ("compliance", "neq", '"disclosure required by law"')}),
    _rule("3.4", "competition_limit", "prohibition", "use", "Recipient must not use Data to build rival goods.", ("purpose", "eq", '"rival goods"')),
    _head("4", "Keeping it safe", "confidentiality", "secure_storage", "encryption", "storage_limit"),
    _rule("4.1", "confidentiality", "obligation", "keepConfidential", "Recipient must hold Data in confidence."),
    _rule("4.2", "secure_storage", "obligation", "store", "Recipient must store Data behind safe doors.", ("security", "eq", '"secure"')),
    _rule("4.3", "encryption", "obligation", "encrypt", "Recipient must encrypt Data with AES-256.", ("security", "eq", '"AES-256"')),
    _rule("4.4", "storage_limit", "prohibition", "store", "Recipient must not store Data outside Norway or Sweden.", ("spatial", "isNoneOf", '["Norway","Sweden"]')),
    _head("5", "Ends and accidents", "deletion", "notification"),
    _rule("5.1", "deletion", "obligation", "delete", "Recipient must delete Data within {days} days after the end, subject to clauses 4.1 to 4.3.", ("elapsedTime", "lteq", '"P{days}D"'), ("event", "eq", '"termination"'), extra={"legal_retention": ("compliance", "neq", '"retention required by law"')}),
    _rule("5.2", "notification", "obligation", "notify", "Recipient must tell Provider of every Incident within {hours} hours after it is known.", ("recipient", "eq", '"Provider"'), ("elapsedTime", "lteq", '"PT{hours}H"'), ("event", "eq", '"incident"'), asset="Incident"),
    _head("6", "The portal", "platform_access"),
    _rule("6.1", "platform_access", "permission", "provideAccess", "Provider may open Platform to Recipient as it sees fit.", ("recipient", "eq", '"Recipient"'), ("discretion", "eq", '"sole discretion"'), ("security", "eq", '"requirements"'), ("scope", "eq", '"electronic access"'), asset="Platform", actor="Provider"),
    _rule("6.2", "platform_access", "prohibition", "read", "Recipient must not read Platform while it falls short of the requirements.", ("security", "neq", '"requirements"'), asset="Platform"),
    _head("7", "Records", "records_access"),
    _rule("7.1", "records_access", "obligation", "maintain", "Recipient must maintain complete Records of its work.", ("completeness", "eq", '"complete"'), ("scope", "eq", '"all processing"'), asset="Records"),
    _rule("7.2", "records_access", "obligation", "provideAccess", "Recipient must hand the Records of clause 7.1 to Provider when asked.", ("recipient", "eq", '"Provider"'), ("event", "eq", '"request"'), ("scope", "eq", '"all processing"'), asset="Records"),
    _head("8", "Earlier material", "background_access"),
    _rule("8.1", "background_access", "permission", "read", "From {start} to {stop} Recipient may read Background free of charge.", ("dateTime", "gteq", '"{start}"'), ("dateTime", "lteq", '"{stop}"'), ("payAmount", "eq", "0"), ("scope", "eq", '"own work"'), ("compliance", "eq", '"work plan"'), asset="Background"),
    _rule("8.2", "background_access", "prohibition", "use", "Recipient must only use Background for {U} or with written consent.", ("purpose", "neq", '"{U}"'), ("approval", "neq", '"written consent"'), asset="Background"),
    _head("9", "Going public", "publication"),
    _rule("9.1", "publication", "obligation", "notify", "Recipient must show Results to Provider before they appear.", ("recipient", "eq", '"Provider"'), ("timing", "eq", '"before publication"'), asset="Results"),
    _rule("9.2", "publication", "permission", "requestDelay", "Provider may hold Results back for up to {delay} days if it says so within {notice} days after the notice.", ("postponementDuration", "lteq", '"P{delay}D"'), ("elapsedTime", "lteq", '"P{notice}D"'), ("event", "eq", '"notice"'), asset="Results", actor="Provider"),
    _rule("9.3", "publication", "permission", "publish", "Once {notice} days have elapsed since the notice Recipient may publish Results that met no objection.", ("elapsedTime", "gteq", '"P{notice}D"'), ("event", "eq", '"notice"'), ("approval", "eq", '"no objection"'), ("compliance", "eq", '"nothing confidential"'), asset="Results"),
    _rule("9.4", "publication", "permission", "publish", "Once {delay} days have elapsed since an objection Recipient may publish Results that answer it.", ("elapsedTime", "gteq", '"P{delay}D"'), ("event", "eq", '"objection"'), ("approval", "eq", '"objection met"'), ("compliance", "eq", '"nothing confidential"'), asset="Results"),
    _head("10", "Care and closing", "authorized_access", "no_reidentification", "attribution", "error_reporting", "deletion_certificate", "provider_delivery"),
    _rule("10.1", "authorized_access", "prohibition", "provideAccess", "Recipient must not let anyone but its listed staff see Data.", ("recipient", "neq", '"listed staff"')),
    _rule("10.2", "no_reidentification", "prohibition", "reidentify", "Recipient must not reidentify people from Data."),
    _rule("10.3", "attribution", "obligation", "attribute", "Recipient must attribute Provider when publishing Results.", ("recipient", "eq", '"Provider"'), ("timing", "eq", '"when publishing"'), asset="Results"),
    _rule("10.4", "error_reporting", "obligation", "notify", "Recipient must report every Error to Provider within {hours} hours after finding it.", ("recipient", "eq", '"Provider"'), ("elapsedTime", "lteq", '"PT{hours}H"'), ("event", "eq", '"error"'), asset="Error"),
    _rule("10.5", "deletion_certificate", "obligation", "submit", "Recipient must submit Certificate to Provider within {notice} days after deletion.", ("recipient", "eq", '"Provider"'), ("elapsedTime", "lteq", '"P{notice}D"'), ("event", "eq", '"deletion"'), asset="Certificate"),
    _rule("10.6", "provider_delivery", "obligation", "share", "Provider must share Data with Recipient within {notice} days after signing.", ("recipient", "eq", '"Recipient"'), ("elapsedTime", "lteq", '"P{notice}D"'), ("event", "eq", '"signature"'), actor="Provider"),
    _rule("10.7", "provider_delivery", "obligation", "share", "Provider must share Documentation with Recipient within {notice} days after signing.", ("recipient", "eq", '"Recipient"'), ("elapsedTime", "lteq", '"P{notice}D"'), ("event", "eq", '"signature"'), asset="Documentation", actor="Provider"),
    _head("11", "Odds and ends"),
    Clause("11.1", "Each side retains ownership of what it brings; this paper transfers no ownership of Data.", relevant=True),
    Clause("11.2", "Meetings are agreed by telephone, see clause 12.99."),
    Clause("11.3", "Article 5 of Regulation (EU) 2023/2854 stays untouched."),
    Clause("11.4", "Neither side promises success."),
    _head("12", "Further terms"),
    Clause("12.1", "Recipient sees to it that:", relevant=True),
    Clause("12.1(a)", "Personal Data is masked before any use of Data, as clauses 4.1–4.3 and clause 3.1 of this agreement say;", ("deletion", "encryption"), relevant=True),
    Clause("12.1(b)", "authorized users follow Articles 2.1, 2.2 and Article 28 of the GDPR; and", relevant=True),
    Clause("12.1(b)(i)", "records of the Platform are kept.", relevant=True),
    Clause("12.2", "Personal Data means all Data about a person.\nAuthorized Users means listed staff of Recipient and its Service Providers.\nDate: ______", relevant=True),
    Clause("12.3", "Service Providers: firms that act for Recipient under clause 2.1.", relevant=True),
    Clause("12.4", "See clause 2.1, clause 1.1 of Annex A, Exhibit Z, clause 1.2 of the main agreement and Article 5 of the Data Act.", ("read", "attribution"), relevant=True),
    Clause("12.5", "Errors are told without undue delay. For the duration of the work, Records are kept. During the term, and for a subsequent period of two years, Data stays secret.", ("notification", "storage_limit"), relevant=True),
    Clause("12.6", "☐ Standard delivery", ("platform_access",), relevant=True),
    Clause("12.7", "About this paper:\nHow to read it?\nSee https://example.org/help for more.", ("publication",), relevant=True),
    Clause("12.8", "Provider retains ownership of Data; this paper transfers no ownership of it.", relevant=True),
    Clause("12.9", "Clauses 3.1-3.4, clauses 9.1 to 10.2 and clause 12.77 are cited for order only, and for information only."),
    Clause("", "ANNEX A", heading=True, scope=1),
    _head("1", "Delivery", scope=1),
    Clause("1.1", "Bundle means the files that Provider hands over.", scope=1, relevant=True),
    Clause("1.2", "Provider shall supply the necessary documentation with each Bundle described in clause 1.1.", scope=1, relevant=True),
    Clause("1.3", "Delivery Window means two days. Bundle checks follow clause 2.2 and clause 3.1 of the main agreement.", scope=1, relevant=True),
    Clause("1.4", "Data means the annexed files only.", ("sharing_limit",), scope=1, relevant=True),
]
