"""Word lists, rule ids, weights and limits that results depend on."""

from __future__ import annotations

# Severities in order, and categories.
SEVERITIES = ("low", "medium", "high")
CATEGORIES = ("SECRET", "PII", "INFRA", "BUSINESS")

# Symbols that make a value look like a credential.
CREDENTIAL_SYMBOLS = "@#$%^&*!?~"

# Words that are types, placeholders or parameters rather than account names.
TYPE_WORDS = (
    "string str int integer bool boolean float double decimal none null nil undefined any unknown object text varchar char uuid guid optional union list dict array number "
    "date datetime timestamp self this value name user username input field required default example todo changeme email mail password passwd pwd secret token key id url uri "
    "host hostname port path data config params args kwargs options opts request response req res session client server context ctx payload body headers result error err "
    "callback cb func fn def class return async await import export const let var credentials credential profile handler manager account"
).split()

# Keywords of numbers, with their length in digits; window of 4 tokens to either side.
NUMBER_GROUPS = (
    ("phone", "Phone Number (contextual)", "medium", "phone mobile cell call contact tel telephone whatsapp".split(), 7, 15),
    ("account-number", "Account Number (contextual)", "high", "account acct a/c".split(), 6, 18),
    ("customer-id", "Customer/Employee/Order/Loan ID (contextual)", "medium", "customer employee order loan policy ticket case claim".split(), 4, 15),
)
NUMBER_WINDOW = 4

# Keywords and shapes of alphanumeric ids; window of 4 tokens.
ID_GROUPS = (
    ("passport-us", "US Passport Number (contextual)", "passport passports".split(), r"[0-9]{9}|[A-Z][0-9]{8}"),
    ("drivers-license-us", "US Driver's License Number (contextual)", "license licence licenses licences dl driver drivers driving".split(), r"[A-Z][0-9]{6,8}|[0-9]{7,9}"),
)

# Keywords of bare national ids, of host names and of ports, with their windows.
AADHAAR_KEYWORDS, AADHAAR_WINDOW = "aadhaar aadhar uidai uid".split(), 4
HOST_KEYWORDS, HOST_WINDOW = "server host hostname db database node cluster instance machine box vm pod ssh deploy provision".split(), 4
PORT_KEYWORDS, PORT_WINDOW = ["port"], 3

# Capitalized words that are no names.
NOT_NAMES = "The This That These Those Please Thanks Hello Hi January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()

# Roots of file paths (real, and those that identify somebody), host words and addresses that say nothing.
REAL_ROOTS = "etc var usr opt srv mnt media tmp bin sbin lib lib64 dev proc sys boot run home root Users Applications Library System Volumes private cores".split()
HOME_ROOTS = "Users home root".split()
IDENTIFYING_ROOTS = "Users home root opt srv Volumes mnt media".split()
INTERNAL_HINTS = "internal corp intranet lan vpn svc cluster".split()
LOOPBACK_HOSTS = "localhost 127.0.0.1 0.0.0.0 ::1 [::1] host.docker.internal".split()
PLAIN_IPV4 = "127.0.0.1 0.0.0.0 255.255.255.255 255.255.255.254 255.255.255.252 255.255.255.248 255.255.255.240 255.255.255.224 255.255.255.192 255.255.255.128 255.255.255.0 255.255.0.0 255.0.0.0".split()
PLAIN_IPV6 = "::1 ::".split()

# Conversational keywords in order of precedence within a length: phrase, label, whether an account name follows.
PHRASES = (
    ("password", "Password (conversational)", False),
    ("passwd", "Password (conversational)", False),
    ("pwd", "Password (conversational)", False),
    ("pwrd", "Password (conversational)", False),
    ("pd", "Password (conversational)", False),
    ("pass", "Password (conversational)", False),
    ("passphrase", "Passphrase (conversational)", False),
    ("secret", "Secret (conversational)", False),
    ("cred", "Credential (conversational)", False),
    ("creds", "Credential (conversational)", False),
    ("credential", "Credential (conversational)", False),
    ("credentials", "Credential (conversational)", False),
    ("api key", "API Key (conversational)", False),
    ("key", "API Key (conversational)", False),
    ("apikey", "API Key (conversational)", False),
    ("access token", "Access Token (conversational)", False),
    ("auth token", "Auth Token (conversational)", False),
    ("bearer token", "Bearer Token (conversational)", False),
    ("client secret", "Client Secret (conversational)", False),
    ("private key", "Private Key (conversational)", False),
    ("connection string", "Connection String (conversational)", False),
    ("token", "Token (conversational)", False),
    ("tokn", "Token (conversational)", False),
    ("username", "Username (conversational)", True),
    ("user name", "Username (conversational)", True),
    ("userid", "Username (conversational)", True),
    ("user id", "Username (conversational)", True),
    ("account name", "Username (conversational)", True),
    ("service account", "Username (conversational)", True),
    ("user", "Username (conversational)", True),
)
PHRASE_WINDOW, NAME_WINDOW, FUZZY_FLOOR, FUZZY_LONG = 6, 3, 8, 9

# Rules that also fire inside comments.
COMMENT_RULES = (
    "aws-access-key aws-secret-key private-key-block generic-api-key openai-api-key stripe-api-key jwt slack-token github-token generic-password-assignment env-var-secret "
    "db-connection-string sqlserver-connection-string"
).split()

# Thresholds, in order: routing, business flag, semantic match; turns of carry-over; semantic bands and window.
ROUTE_MIN, BUSINESS_MIN, SEMANTIC_MIN = 0.15, 0.4, 0.5
CARRY_TURNS = 2
SEMANTIC_BANDS, BUSINESS_BANDS, SEMANTIC_WINDOW = (0.6, 0.75), (0.45, 0.55), 6

# Words that the semantic layer never asks about.
SEMANTIC_STOPWORDS = (
    "the a an and or but is are was were be to of in on at for with my your our this that it as by from can you help me please write what how does do here there server "
    "port number address key keys access node service connection identifier name host hostname id code account phone card login user username secret token password credential "
    "credentials value config record index count status message request response header field label type data string license date birth"
).split()

# Names of JSON fields that are masked whole: category and severity.
FIELD_NAMES = {
    "password": ("SECRET", "high"), "passwd": ("SECRET", "high"), "pwd": ("SECRET", "high"), "secret": ("SECRET", "high"), "apikey": ("SECRET", "high"),
    "accesstoken": ("SECRET", "high"), "authtoken": ("SECRET", "high"), "token": ("SECRET", "medium"), "privatekey": ("SECRET", "high"), "clientsecret": ("SECRET", "high"),
    "ssn": ("PII", "high"), "aadhaar": ("PII", "high"), "pan": ("PII", "high"), "accountnumber": ("PII", "high"), "cardnumber": ("PII", "high"), "creditcard": ("PII", "high"),
    "email": ("PII", "low"), "phone": ("PII", "medium"), "phonenumber": ("PII", "medium"), "username": ("PII", "medium"),
    "ipaddress": ("INFRA", "medium"), "hostname": ("INFRA", "medium"), "host": ("INFRA", "medium"),
}

# Placeholder types by what a rule id contains (or, with =, is); the first that holds decides, else the category.
ENTITY_TYPES = (
    ("AMOUNT_INR", "amount-inr"),
    ("AMOUNT_USD", "amount-usd"),
    ("AMOUNT", "amount"),
    ("PERSON", "person-name"),
    ("USERNAME", "username user-name user-id userid login account-name service-account =proximity-user"),
    ("EMAIL", "email"),
    ("PHONE", "phone"),
    ("PAN", "pan-india"),
    ("AADHAAR", "aadhaar"),
    ("SSN", "ssn"),
    ("PASSPORT", "passport"),
    ("DRIVERS_LICENSE", "drivers-license"),
    ("CARD_NUMBER", "credit-card"),
    ("IFSC", "ifsc"),
    ("ACCOUNT_NUMBER", "account-number"),
    ("CUSTOMER_ID", "customer-id"),
    ("PASSWORD", "password passwd pwd =proximity-pd =proximity-pass =proximity-pwrd"),
    ("PASSPHRASE", "passphrase"),
    ("API_KEY", "api-key apikey =proximity-key"),
    ("AWS_KEY", "aws"),
    ("GITHUB_TOKEN", "github"),
    ("SLACK_TOKEN", "slack"),
    ("JWT", "jwt"),
    ("PRIVATE_KEY", "private-key"),
    ("DB_CONNECTION_STRING", "connection-string"),
    ("CREDENTIAL", "creds credential"),
    ("SECRET", "secret"),
    ("TOKEN", "token =proximity-tokn"),
    ("MAC_ADDRESS", "mac-address"),
    ("IPV6", "ipv6"),
    ("IP_ADDRESS", "ip"),
    ("HOSTNAME", "=internal-url =external-url hostname"),
    ("PORT", "port"),
    ("URL", "url"),
    ("FILE_PATH", "path"),
)
