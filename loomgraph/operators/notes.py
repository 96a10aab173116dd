"""Short teaching notes by language and concept, each in two voices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# language group: concept | title | easy | expert. The concept ids are fixed
# values; the wording is this library's own.
_TEXT = """
python
dataclass | Data class | A class that mostly holds values; Python writes its setup code. | Generates init, repr and eq from annotated fields.
protocol | Protocol | A promise about what an object can do, whatever its class. | Structural subtype checked by shape.
pattern-matching | Pattern matching | Picks a branch by the shape of a value. | Structural match statement with binding patterns.
f-string | Formatted text | Text with values filled in. | Interpolated literal evaluated at runtime.
walrus | Assign and use | Stores a value and uses it at once. | Assignment expression in an enclosing expression.
decorator | Decorator | Wraps a function or class to add behaviour. | Callable applied to the definition at bind time.
comprehension | Comprehension | Builds a collection in one line. | Eager list, set or dict display with its own scope.
generator | Generator | Hands out values one at a time. | Lazy iterator from yield or a generator expression.
context-manager | With block | Opens something and closes it afterwards. | Enter and exit protocol around a block.
async-await | Async code | Waits without blocking everything else. | Coroutine suspension point or definition.
dunder-method | Special method | A method Python itself calls. | Data-model hook invoked by syntax or builtins.
exception-handling | Error handling | Says what to do when something fails. | Raise, or try with handlers.
type-hint | Type hint | Notes what kind of value is expected. | Static annotation, not enforced at runtime.
javascript typescript
async-await | Async code | Waits for a result without freezing. | Promise suspension in an async function.
arrow-function | Arrow function | A short way to write a function. | Lexical this, no own arguments object.
destructuring | Unpacking | Takes values out of an object or list. | Binding pattern over a structure.
optional-chaining | Safe access | Stops quietly if something is missing. | Short-circuits on null or undefined.
nullish-coalescing | Fallback value | Uses a spare value if the first is missing. | Right side only on null or undefined.
module-syntax | Modules | Shares code between files. | Static import and export bindings.
type-annotation | Type note | Says what kind of value this is. | Compile-time type on a binding.
interface | Interface | Describes the shape of an object. | Structural, mergeable object type.
generic | Generic | Works with many kinds of values. | Type parameterised declaration.
jsx | JSX | Writes page parts inside code. | Element expressions compiled to calls.
go
goroutine | Goroutine | Starts work that runs alongside. | Lightweight concurrent call.
channel | Channel | Passes values between running parts. | Typed synchronised conduit.
defer | Defer | Saves a step for when the function ends. | Call run at return in reverse order.
error-return | Error result | Gives back an error with the value. | Error as a trailing result.
interface-assertion | Type check | Asks what an interface value really is. | Dynamic type assertion or switch.
struct-embedding | Embedding | Puts one struct inside another. | Promoted fields and methods.
generics | Generics | One function for many types. | Type parameters with constraints.
java
annotation | Annotation | A label other tools read. | Metadata on a declaration.
lambda | Lambda | A small function without a name. | Functional interface instance.
generic | Generic | Works with many types. | Erased type parameter.
record | Record | A short class for fixed data. | Immutable carrier with derived members.
sealed-type | Sealed type | Only listed classes may extend it. | Closed hierarchy by permits.
default-method | Default method | An interface method with a body. | Inherited unless overridden.
try-with-resources | Auto-close | Closes what it opened. | AutoCloseable scope.
stream | Stream | Processes items step by step. | Lazy pipeline over a source.
rust
trait | Trait | Describes what a type can do. | Shared behaviour with default items.
impl | Impl block | Adds functions to a type. | Inherent or trait implementation.
borrowing | Borrowing | Uses a value without taking it. | Shared reference.
mutable-borrow | Mutable borrow | May change a borrowed value. | Exclusive reference.
lifetime | Lifetime | Says how long a borrow lasts. | Region parameter on references.
pattern-matching | Match | Chooses by the shape of a value. | Exhaustive match.
result-option | Result or Option | May hold a value or not. | Sum types for failure and absence.
question-mark-operator | Question mark | Stops early on an error. | Early return with conversion.
async-await | Async code | Waits without blocking. | Future polling point.
macro | Macro | Code that writes code. | Syntactic expansion.
unsafe | Unsafe | Steps outside the usual checks. | Obligations moved to the author.
csharp
linq-query | Query | Asks questions of a collection. | Query syntax over sequences.
async-await | Async code | Waits without freezing. | Task continuation.
property-accessors | Property | A value with get and set steps. | Accessor pair on a member.
record | Record | A short type for data. | Value equality reference or struct type.
nullable-type | May be empty | A value that can be missing. | Nullable value or reference annotation.
pattern-matching | Pattern | Checks the shape of a value. | Pattern in is or switch.
extension-method | Extension | Adds a method from outside. | Static method with this parameter.
generic | Generic | Works with many types. | Reified type parameter.
"""


def notes(spark: SparkSession) -> DataFrame:
    """``(language, concept, title, easy, expert)``, a table of fixed size."""
    rows: list[tuple[str, ...]] = []
    languages: list[str] = []
    for line in _TEXT.strip().splitlines():
        parts = [p.strip() for p in line.split("|")]
        if len(parts) == 1:
            languages = line.split()
            continue
        rows += [(language, *parts) for language in languages]
    return spark.createDataFrame(rows, "language string, concept string, title string, easy string, expert string")
