"""Labelled exemplars of residue: what pages, servers, browsers, programs and layouts say in place of content.

Fixed values: common wordings in seven languages, one exemplar a line. More labelled exemplars can be passed to the operator.
"""

NOTICES = """
error | The page you requested could not be found. It may have been moved or deleted. Go back to the start page.
error | Sorry, this page could not be shown right now. Please go back and try again in a few minutes.
error | Sorry, the page you asked for could not be shown. Go back or try again in a few minutes.
error | Page not found. The page you are looking for does not exist or is no longer there.
error | Oops, something went wrong. Nothing was saved. We are sorry for the inconvenience, please try later.
error | An unexpected error occurred. Please try again later or contact support if the problem persists.
error | Problem loading this section, chapter or report. It failed to load, is gone, is missing or has moved.
error | Sorry, the page, section, chapter or report failed to load. Please try later.
error | We are sorry: this chapter, shelf, archive, catalogue, library, room, reading room or list could not be opened, reached, found, loaded or displayed.
error | Sorry, we are sorry, oops, notice: the requested or this file, page, document, section or chapter failed to load, is gone, is missing or has moved. Nothing was saved. Please try later.
error | Notice: this page is down for repair or maintenance. Ask the help desk, contact support and quote the code.
error | The site is down for scheduled maintenance. We will be back soon.
error | Access denied. You do not have permission to view or open this page or resource.
error | Access denied. You do not have the rights to open this resource. Reference number.
error | HTTP: not found. The upstream node or server gave no answer. Incident, request, trace or ray id.
error | HTTP error: not found, forbidden, unauthorized, bad request, bad gateway, gateway timeout, internal server error, service unavailable, too many requests. The upstream node gave no answer. Incident.
error | The page, server or request took too long to respond, answer, load or open. Timeout.
error | The server encountered an internal error and was unable to complete your request.
error | The service is temporarily unavailable. Please try again later.
error | Your session has expired or timed out. Please sign in or log in again to continue.
error | Your session has ended. Sign in again to go on reading.
error | Rate limit reached or exceeded for this minute. Please slow down and wait. Id
error | Too many requests. Please slow down and try again later.
error | Connection reset, refused, lost or timed out while waiting for the server or worker. Retry of failed.
error | Could not load or open the file, model, model weights or slot: error code, aborting slot, giving up.
error | out of memory: tried or failed to allocate MiB for the cache, giving up. killed
error | panic: worker or thread exited with status or signal; no output produced.
error | segmentation fault, core dumped, killed by signal
error | Traceback most recent call last: file line in module, exception, runtime error, null pointer, stack trace, fatal
error | error code message trace: bad gateway, gateway timeout, forbidden, not found, too many requests, internal server error, service unavailable, bad request, unauthorized; status, detail, reason, request id
error | Not Found, Bad Gateway, Gateway Timeout, Forbidden, Unauthorized, Bad Request, Internal Server Error, Service Unavailable, Too Many Requests. Ref
error | Die angeforderte Seite wurde nicht gefunden oder konnte nicht geladen werden. Fehler, Vorgang.
error | Es ist ein Fehler aufgetreten. Bitte versuchen Sie es später erneut.
error | Der Dienst ist vorübergehend nicht verfügbar. Zugriff verweigert. Sitzung abgelaufen.
error | Erreur: le service est momentanément indisponible. Veuillez réessayer plus tard.
error | Page introuvable. La page demandée n'existe pas ou plus. Accès refusé.
error | Error: no se pudo cargar el contenido solicitado. Inténtelo de nuevo más tarde.
error | Página no encontrada. Acceso denegado. El servicio no está disponible.
error | Błąd: strona nie istnieje lub została przeniesiona. Spróbuj ponownie później.
error | Usługa niedostępna. Odmowa dostępu. Nie znaleziono strony.
error | Ошибка. Страница временно недоступна, попробуйте позже.
error | Страница не найдена. Доступ запрещён, сервер не отвечает.
error | Erro: a página não foi encontrada ou não está disponível. Tente novamente mais tarde.
error | Acesso negado. Serviço indisponível.
script | JavaScript appears to be disabled in your browser. Please enable JavaScript and reload the page.
script | This site, reader, page or app needs or requires JavaScript and cookies to work.
script | Please enable JavaScript to view this content, page or site or to continue.
script | Allow scripts and cookies, then refresh. Turn it on and reload. Code
script | Your browser or viewer does not run or support scripts. Code
script | Scripting is switched off, turned off or blocked in your viewer or browser.
script | We could not start the app because scripts are blocked.
script | Checking that you are not a robot. Please wait while we verify that you are human.
script | noscript
script | Bitte aktivieren Sie JavaScript, um diesen Inhalt zu sehen oder diese Seite anzuzeigen.
script | Veuillez activer JavaScript pour afficher cette page ou ce contenu.
script | Active o habilite JavaScript para continuar o ver esta página.
script | Włącz obsługę JavaScript, aby wyświetlić tę stronę i kontynuować.
script | Включите JavaScript, чтобы открыть или просмотреть этот раздел или эту страницу.
script | Ative o JavaScript para continuar ou ver esta página.
filler | Sample analysis goes here. Sample text goes here. Replace this paragraph or text with the final wording or content.
filler | This is dummy copy for layout purposes only. Do not publish it.
filler | This is placeholder text for layout purposes only. Do not print it.
filler | Your review text will appear in this space. Write two or three sentences here.
filler | Type something here. Enter your text here. Your text here. Example text.
filler | Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
filler | Blah blah. Foo bar baz. Test test. Text here. Xxx. asdf qwerty.
filler | Texte ici. Texto aquí. Texto aqui. Beispieltext. Tekst tutaj. Текст здесь.
filler | Platzhaltertext oder Blindtext für die Auswertung. Bitte später ersetzen.
filler | Texte provisoire ou faux texte, à remplacer avant la remise du rapport.
filler | Texto de relleno para la maqueta. No tiene contenido. Texto provisional.
filler | Tekst zastępczy do układu strony, proszę później zastąpić.
filler | Текст-заполнитель для макета, рыба, заменить перед сдачей.
filler | Texto provisório para o layout, substituir antes da entrega.
"""

#: Exemplars of unfilled placeholders. The marks at both ends are a word of the index; … stands for any words.
PLACEHOLDERS = """
{{…}}
{%…%}
<%…%>
${…}
#{…}
{…}
%(…)
%…%
@@…@@
__…__
<<…>>
[[…]]
____
XXXX
TODO
FIXME
TBD
<your here>
<insert here>
<enter here>
<name of author>
[insert here]
[insert your name here]
[inserted text here]
[enter your name here]
[enter value here]
[add text here]
[fill in here]
[fill in the value]
[replace me]
[replace this text]
[placeholder]
[missing value]
[your name here]
[your name]
[your text here]
[name of author]
[name of the author]
[author name]
[todo]
[fixme]
[tbd]
[pending]
[xxx]
[xxxx]
[hier text einfügen]
[hier eintragen]
[bitte ausfüllen]
[bitte ergänzen]
[name des autors]
[rellenar]
[rellenar aquí]
[completar]
[insertar texto aquí]
[nombre del autor]
[insérer le texte ici]
[à compléter]
[à remplir]
[nom de l'auteur]
[wstaw tekst tutaj]
[uzupełnij]
[do uzupełnienia]
[imię autora]
[вставить текст сюда]
[вставьте текст здесь]
[заполнить]
[заполните]
[имя автора]
[inserir texto aqui]
[preencher]
[preencher aqui]
[nome do autor]
"""
