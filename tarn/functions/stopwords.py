"""Stop words: small lists that may be shared freely; longer ones are the user's to give, as lists or files."""

from __future__ import annotations

from collections.abc import Iterable

# Function words by language.
_LISTS = {
    "english": "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with",
    "french": "au aux avec ce ces dans de des du elle en et eux il ils je la le les leur lui ma mais me même mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous",
    "german": "aber alle als also am an auch auf aus bei bin bis da das dass dein dem den der des die dir du ein eine einem einen einer er es für haben hat hier ich ihr im in ist ja kann mein mich mir mit nach nicht nur oder sein sich sie sind so um und uns vom von war was wenn wer wie wir zu zum zur",
    "spanish": "al algo como con cual de del desde donde el ella ellos en entre era es esta este esto fue ha hay la las lo los más me mi mucho muy no nos o os otra otro para pero poco por porque que quien se sin sobre su sus también te tu un una uno y ya yo",
    "italian": "a al alla anche che chi ci come con da dal del della di e ed è gli i il in io la le lo ma mi nel non o per più quella questo se si sono su tra un una",
    "portuguese": "a ao as com como da das de do dos e ela ele em entre era eu foi isso já mas me mesmo na nas não no nos o os ou para pela por que se sem seu sua também te um uma você",
    "dutch": "aan al als bij dan dat de der deze die dit een en er het hij ik in is je kan maar me met mijn na naar niet nog nu of om onder ook op over te tot u uit van voor was we wij ze zij zijn zo",
    "swedish": "alla att av de den det dig du där efter ej eller en er ett från för ha han har hon i icke inte jag kan man med men min mot nu när och om på sig sin som så till under upp ut var vi vid är över",
    "russian": "а без бы был в вам вас весь во вот все вы да для до его ее если есть еще же за и из или их к как ко ли мне мы на не нет но о он она они от по с так то ты у что это я",
}
#: Query words of a search service rather than of the language; the second family adds them.
_EXTRA_ENGLISH = "about above after again all also am any because been before being below between both can could did do does doing down during each few from further had has have having he her here hers him his how i its just me more most my now off once only other our out over own same she should so some than them through too under until up very we were what when where which while who whom why would you your"

FAMILIES = ("lucene", "terrier")


def stop_words(language: str = "english", family: str = "lucene") -> list[str]:
    """The sorted list of a family; only English has a list in the second one."""
    from tarn.functions.tokenizers import language as full

    if family not in FAMILIES:
        raise ValueError(f"unknown stop word family '{family}', expected one of: {', '.join(FAMILIES)}")
    name = full(language)
    if name not in _LISTS or (family == "terrier" and name != "english"):
        raise ValueError(f"no '{family}' stop words for {name}")
    words = set(_LISTS[name].split())
    return sorted(words | set(_EXTRA_ENGLISH.split()) if family == "terrier" else words)


def resolve(choice: bool | str | Iterable[str] | None, default: str | None, language: str = "english") -> list[str]:
    """The words for a setting: a family's name, a list, True (the default family or the first), False, or None (the default)."""
    if choice is None:
        return stop_words(language, default) if default else []
    if choice is False:
        return []
    if choice is True:
        return stop_words(language, default or FAMILIES[0])
    if isinstance(choice, str):
        return stop_words(language, choice)
    return sorted({str(w) for w in choice})
