"""Stop words. Long lists are read from files, one word a line and "|" or "#" before remarks."""

from __future__ import annotations

import re

#: The short English list, and the full one of the Snowball project.
ENGLISH = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was with".split()
FULL_ENGLISH = """
a about above after again against all am an and any are aren't as at be because been before being below between both but by
cannot can't could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't
have haven't having he he'd he'll her here here's hers herself he's him himself his how how's i i'd if i'll i'm in into is isn't
it its it's itself i've let's me more most mustn't my myself no nor not of off on once only or other ought our ours ourselves out
over own same shan't she she'd she'll she's should shouldn't so some such than that that's the their theirs them themselves then
there there's these they they'd they'll they're they've this those through to too under until up very was wasn't we we'd we'll
were we're weren't we've what what's when when's where where's which while who whom who's why why's with won't would wouldn't you
you'd you'll your you're yours yourself yourselves you've
""".split()
#: The full English list and more words.
EXTENDED_ENGLISH = FULL_ENGLISH + "one every least less many now ever never say says said also get go goes just made make put see seen whether like well back even still way take since another however two three four five first second new old high long".split()

#: The Snowball project's lists for French, Dutch, Swedish, Norwegian and Danish. Longer ones are read with ``load``.
FRENCH = """
au aux avec ce ces dans de des du elle en et eux il je la le leur lui ma mais me même mes moi mon ne nos notre nous on ou par pas
pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous c d j l à m n s t y été étée étées étés étant étante
étants étantes suis es est sommes êtes sont serai seras sera serons serez seront serais serait serions seriez seraient étais était
étions étiez étaient fus fut fûmes fûtes furent sois soit soyons soyez soient fusse fusses fût fussions fussiez fussent ayant
ayante ayantes ayants eu eue eues eus ai as avons avez ont aurai auras aura aurons aurez auront aurais aurait aurions auriez
auraient avais avait avions aviez avaient eut eûmes eûtes eurent aie aies ait ayons ayez aient eusse eusses eût eussions eussiez
eussent
""".split()
DUTCH = """
de en van ik te dat die in een hij het niet zijn is was op aan met als voor had er maar om hem dan zou of wat mijn men dit zo door
over ze zich bij ook tot je mij uit der daar haar naar heb hoe heeft hebben deze u want nog zal me zij nu ge geen omdat iets
worden toch al waren veel meer doen toen moet ben zonder kan hun dus alles onder ja eens hier wie werd altijd doch wordt wezen
kunnen ons zelf tegen na reeds wil kon niets uw iemand geweest andere
""".split()
SWEDISH = """
och det att i en jag hon som han på den med var sig för så till är men ett om hade de av icke mig du henne då sin nu har inte hans
honom skulle hennes där min man ej vid kunde något från ut när efter upp vi dem vara vad över än dig kan sina här ha mot alla
under någon eller allt mycket sedan ju denna själv detta åt utan varit hur ingen mitt ni bli blev oss din dessa några deras blir
mina samma vilken er sådan vår blivit dess inom mellan sådant varför varje vilka ditt vem vilket sitta sådana vart dina vars vårt
våra ert era vilkas
""".split()
NORWEGIAN = """
og i jeg det at en et den til er som på de med han av ikke ikkje der så var meg seg men ett har om vi min mitt ha hadde hun nå
over da ved fra du ut sin dem oss opp man kan hans hvor eller hva skal selv sjøl her alle vil bli ble blei blitt kunne inn når
være kom noen noe ville dere som deres kun ja etter ned skulle denne for deg si sine sitt mot å meget hvorfor dette disse uten
hvordan ingen din ditt blir samme hvilken hvilke sånn inni mellom vår hver hvem vors hvis både bare enn fordi før mange også slik
vært være båe begge siden dykk dykkar dei deira deires deim di då eg ein eit eitt elles honom hjå ho hoe henne hennar hennes hoss
hossen ikkje ingi inkje korleis korso kva kvar kvarhelst kven kvi kvifor me medan mi mine mykje no nokon noka nokor noko nokre si
sia sidan so somt somme um upp vere vore verte vort varte vart
""".split()
DANISH = """
og i jeg det at en den til er som på de med han af for ikke der var mig sig men et har om vi min havde ham hun nu over da fra du
ud sin dem os op man hans hvor eller hvad skal selv her alle vil blev kunne ind når være dog noget ville jo deres efter ned skulle
denne end dette mit også under have dig anden hende mine alt meget sit sine vor mod disse hvis din nogle hos blive mange ad bliver
hendes været thi jer sådan
""".split()


def load(path: str) -> list[str]:
    """The words of a stop-word file in Snowball's format, of any language."""
    with open(path, encoding="utf-8") as file:
        return [w for line in file for w in re.split(r"[|#]", line)[0].split()]
