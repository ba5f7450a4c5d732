"""Stop words: closed-class words, written down for this library."""

from __future__ import annotations

_LISTS = {
    "en": """a about above after again against all am an and any are as at be because been before being below between both but by can could did do does
doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not
now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under
until up very was we were what when where which while who whom why will with would you your""",
    "de": """aber alle als also am an auch auf aus bei bin bis bist da dann das dass dem den der des die dies doch du durch ein eine einem einen einer er es
für hat hatte ich ihr im in ist ja jede kann kein man mein mit nach nicht noch nun nur ob oder ohne sein sich sie sind so über um und uns unter vom von vor war
was weil wenn wer wie wir wird wo zu zum zur""",
    "fr": """à au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui ma mais me mes moi mon ne nos notre nous on ou où par
pas plus pour qu que qui sa se ses si son sont sur ta te tes toi ton tu un une vos votre vous y""",
    "es": """a al como con de del el ella ellos en entre era es esta este esto fue ha hay la las le les lo los me mi mis muy más ni no nos o os para pero por
que se si sin sobre son su sus te tu tus un una uno y ya yo""",
}
STOPWORDS: dict[str, tuple[str, ...]] = {k: tuple(sorted(set(v.split()))) for k, v in _LISTS.items()}
